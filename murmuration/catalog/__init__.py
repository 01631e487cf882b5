"""Every operator run over the given tables, with the SQL that checks it."""
