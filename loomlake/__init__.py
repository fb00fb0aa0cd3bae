"""Analytics over repositories of schema-described JSON records, as Spark DataFrame operators."""
