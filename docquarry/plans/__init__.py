"""What a query says: requests, definitions, and the columns they bind to."""
