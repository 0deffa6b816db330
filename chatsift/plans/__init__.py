"""End-to-end plans: the dataset build and the registered driver queries."""
