"""From the text of a query to a DataFrame: lexer, syntax tree, parser, binder, plan listing."""
