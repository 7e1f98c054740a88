"""Rules, the search space, the method catalogue, and the execution of candidates."""
