"""tidemill: analytical SQL on Spark, with SQL-standard results and checked plans."""
