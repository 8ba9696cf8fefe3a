"""Every operator run on the driver tables, with the SQL that says what it should give."""
