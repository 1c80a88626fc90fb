"""Boolean trigram queries from regular expressions.

Any string that a regex matches must satisfy its query, a formula of AND and OR
over trigrams that the string then contains. Literals, alternations, groups,
small classes and counted repeats are followed exactly; what says nothing (a
wide class, an optional part) breaks the run of known characters. All is in
lower case: the index is built over lower-cased text, so the queries hold
whatever the regex's case rules.

A query is ``None`` (says nothing: the rule must scan) or a list of clauses in
disjunctive form, each a frozenset of trigrams that must all be there.
"""

from itertools import product

try:
    from re import _constants as sre_constants
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants
    import sre_parse

#: The most strings that are followed at once, and the most clauses of a query.
MOST_STRINGS = 64
MOST_CLAUSES = 64
WIDE_CLASS = 6


def _class_members(items) -> list[str] | None:
    """Characters of a small class, None if it is wide, negated or named."""
    found: set[str] = set()
    for kind, value in items:
        if kind is sre_constants.LITERAL:
            found.add(chr(value).lower())
        elif kind is sre_constants.RANGE and value[1] - value[0] < 2 * WIDE_CLASS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return sorted(found) if len(found) <= WIDE_CLASS else None


def _sequences(parsed) -> list[list[str | None]]:
    """Ways through a pattern: lists of known pieces, None where anything may stand."""
    ways: list[list[str | None]] = [[]]

    def follow(options: list[list[str | None]]) -> None:
        nonlocal ways
        if len(ways) * len(options) > MOST_STRINGS:
            options = [[None]]
        ways = [a + b for a, b in product(ways, options)]

    for kind, value in parsed:
        if kind is sre_constants.LITERAL:
            follow([[chr(value).lower()]])
        elif kind is sre_constants.IN:
            members = _class_members(value)
            follow([[m] for m in members] if members else [[None]])
        elif kind is sre_constants.BRANCH:
            follow([way for branch in value[1] for way in _sequences(branch)])
        elif kind is sre_constants.SUBPATTERN:
            follow(_sequences(value[3]))
        elif kind in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT):
            low, high, inner = value
            if (low, high) == (0, 1):
                follow([[], *_sequences(inner)])
            else:
                once = _sequences(inner)
                for _ in range(min(low, 3)):
                    follow(once)
                if low != high or low > 3:
                    follow([[None]])
        elif kind in (sre_constants.AT, sre_constants.ASSERT, sre_constants.ASSERT_NOT):
            continue
        else:
            follow([[None]])
    return ways


def _clause(way: list[str | None]) -> frozenset[str]:
    runs = "".join("\0" if piece is None else piece for piece in way).split("\0")
    return frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of which one must hold for a text that ``pattern`` matches anywhere; None if it says nothing."""
    clauses = {_clause(way) for way in _sequences(sre_parse.parse(pattern))}
    if frozenset() in clauses or len(clauses) > MOST_CLAUSES:
        return None
    least = [c for c in clauses if not any(other < c for other in clauses)]
    return sorted(least, key=sorted)
