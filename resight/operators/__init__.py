"""DataFrame operators: cleaning, growth, clutches, histories, tests and models."""
