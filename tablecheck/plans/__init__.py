"""Report sections built on table metrics, each a small frame."""
