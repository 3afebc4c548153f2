"""How a query becomes a plan, and how tables become tracks."""
