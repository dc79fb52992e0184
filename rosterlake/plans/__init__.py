"""Rules and jobs put together from the operators."""
