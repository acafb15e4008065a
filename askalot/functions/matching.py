"""What a text must hold for a regular expression to match it, so that most expressions needn't be tried on most texts."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass, field


@dataclass
class Needs:
    """``clauses``: of each, a text holds at least one literal (in lower case). ``most``: the characters of the longest text, or None."""

    clauses: list[list[str]] = field(default_factory=list)
    most: int | None = None


def needs(pattern: str) -> Needs:
    """What any text has that ``pattern`` matches in any case. Literals that can be absent, classes and look-around ask for nothing."""
    tree = parser.parse(pattern)
    found = sorted({tuple(sorted(c)) for c in _clauses(tree)}, key=lambda c: (-min(map(len, c)), c))
    ends = [arg for op, arg in (tree[0], tree[-1]) if op is sre.AT] if len(tree) else []
    whole = ends == [sre.AT_BEGINNING, sre.AT_END]
    most = tree.getwidth()[1] if whole else sre.MAXREPEAT
    # A dollar also matches before a line break at the end, which may be two characters.
    return Needs([list(c) for c in found], int(most) + 2 if most < 10_000 else None)


def _letter(op, arg) -> str | None:
    """A literal, or a class of one letter in both cases."""
    if op is sre.LITERAL:
        return chr(arg).lower()
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        own = {chr(a).lower() for _, a in arg}
        return own.pop() if len(own) == 1 else None
    return None


def _clauses(tree) -> list[set[str]]:
    found, run = [], ""
    for op, arg in tree:
        c = _letter(op, arg)
        if c is not None:
            run += c
            continue
        if run:
            found.append({run})
            run = ""
        if op is sre.MAX_REPEAT and arg[0] > 0:
            found += _clauses(arg[2])
        elif op is sre.SUBPATTERN:
            found += _clauses(arg[3])
        elif op is sre.BRANCH:
            each = [_clauses(t) for t in arg[1]]
            if all(each):
                found.append(set().union(*[max(own, key=lambda c: min(map(len, c))) for own in each]))
    return [*found, {run}] if run else found
