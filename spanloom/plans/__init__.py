"""Query plans of the driver's entry: every operator over the test tables, with equivalent SQL."""
