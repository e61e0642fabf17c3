"""Query bindings: every operator on the shared tables, with its SQL twin where one exists."""
