"""Following what goes on: journal tails on the driver, and as a stream."""
