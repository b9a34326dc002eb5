"""Row-at-a-time delivery of results."""
