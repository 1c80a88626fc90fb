"""Training-data operators: token counts, decontamination, mixing, media, packing, scans and dedup.

``queries()`` and ``oracle_sql()`` list what this subpackage registers; nothing
else in the library imports it.
"""


def queries():
    from lexweft.llm import registry

    return dict(registry.QUERIES)


def oracle_sql():
    from lexweft.llm import registry

    return dict(registry.ORACLES)
