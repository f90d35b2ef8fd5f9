"""DataFrame operators, from build commands to the merged index and its navigation queries."""
