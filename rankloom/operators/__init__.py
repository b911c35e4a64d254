"""DataFrame operators: index, search, fuse, evaluate, report."""
