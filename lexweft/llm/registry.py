"""All queries of this subpackage by name, and the SQL of those that SQL can express."""

from lexweft.llm import (
    importance,
    language,
    licenses,
    line_dedup,
    media,
    mixing,
    secrets,
    simhash,
    sort_means,
    target_sampling,
    templates,
    token_counts,
    token_files,
)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (token_counts, templates, mixing, media, token_files, secrets, simhash, licenses, line_dedup, importance, language, sort_means, target_sampling):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
