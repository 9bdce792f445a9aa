"""Schema-time planning: column references, value equality, join keys."""
