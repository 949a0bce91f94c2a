"""Query catalog: named Spark plans over the driver tables, each paired with
an independent SQL oracle where the result is SQL-expressible."""
