"""Types and expressions shared by the operators."""
