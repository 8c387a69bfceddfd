"""Reading observations, and the tables that queries use."""
