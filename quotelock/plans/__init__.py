"""Plan shapes shared by the operators, and the queries composed from them."""
