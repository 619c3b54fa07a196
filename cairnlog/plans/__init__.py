"""Plan shapes that stay even when one key holds a large share of the rows."""
