"""Rule tables as expressions.

"Collect every matching type, take the heaviest, the first declared of equals" is one CASE whose
branches are ordered by weight and declaration; Spark evaluates it inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.rule_tables import GENERIC, WEIGHTS
from weftgraph.functions.text import mentions_any


def first_match(lowered: Column, classes: Sequence[tuple[list[str], str]], default: str) -> Column:
    """The first class any of whose keywords occurs."""
    branches = None
    for keywords, name in classes:
        found = mentions_any(lowered, keywords)
        branches = F.when(found, F.lit(name)) if branches is None else branches.when(found, F.lit(name))
    return F.lit(default) if branches is None else branches.otherwise(F.lit(default))


def heaviest(sentence: Column, rules: Mapping[str, list[str]], weights: Mapping[str, int] = WEIGHTS, default: str = GENERIC, flips: Sequence[tuple[str, list[str], str]] = ()) -> Column:
    """The heaviest type that matches, first declared among equals; ``flips`` then turn types round by cue words."""
    lowered = F.lower(sentence)
    order = sorted(rules, key=lambda t: -weights.get(t, 1))  # stable: declaration order among equals
    found = first_match(lowered, [(rules[t], t) for t in order], default)
    turned = None
    for before, cues, after in flips:
        hit = (found == before) & mentions_any(lowered, cues)
        turned = F.when(hit, F.lit(after)) if turned is None else turned.when(hit, F.lit(after))
    return found if turned is None else turned.otherwise(found)


def looked_up(key: Column, table: Mapping[str, str | int]) -> Column:
    """The table's value, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key) if table else F.lit(None)


def weight_of(rel_type: Column, weights: Mapping[str, int] = WEIGHTS) -> Column:
    return F.coalesce(looked_up(rel_type, weights), F.lit(1))
