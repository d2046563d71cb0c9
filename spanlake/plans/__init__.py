"""Role bindings of the operators to the supplied tables, and reports made of several operators."""
