"""quire: DataFrame operators for books as ordered arrays of typed blocks, and the tables around them."""
