"""Package of quern."""
