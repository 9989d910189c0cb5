"""Table operators: filter, order, page, edit, join, group, profile, chart."""
