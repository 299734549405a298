"""Where tables of the keyspace come from and go to."""
