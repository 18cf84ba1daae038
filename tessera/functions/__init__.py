from tessera.functions.hashing import seeded_order, seeded_unit  # noqa: F401
