"""Plan construction: rule catalogs and how they are fused into one pass."""
