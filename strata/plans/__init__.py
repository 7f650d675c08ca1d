"""From command text to plans: lexer, parser, graph, flow plan, journal queries."""
