"""Functions of the dialect as Column expressions: values and their kinds, dates, operators, the function registry."""
