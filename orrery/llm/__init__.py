"""Operators for building training corpora: sharding, filtering, language identification, archives,
quality rules, near-duplicate detection, chat formatting, mixing and packing.

Nothing outside this package imports it."""
