"""Algebra of wildcards: which namespaces they cover, and how strictly what they cover is checked.

A constraint is ``("any",)``, ``("not", excluded)`` or ``("in", namespaces)``.
"""

from __future__ import annotations

Constraint = tuple
STRICTNESS = {"skip": 0, "lax": 1, "strict": 2}


def parse(tokens: str, target: str) -> Constraint:
    if tokens == "##any":
        return ("any",)
    if tokens == "##other":
        return ("not", frozenset(("", target)))
    return ("in", frozenset({"##local": "", "##targetNamespace": target}.get(t, t) for t in tokens.split()))


def allows(c: Constraint, ns: str) -> bool:
    return c[0] == "any" or (ns in c[1]) == (c[0] == "in")


def intersection(a: Constraint, b: Constraint) -> Constraint:
    """Namespaces that both cover."""
    if a[0] == "any":
        return b
    if b[0] == "any":
        return a
    if a[0] == b[0] == "not":
        return ("not", a[1] | b[1])
    inside, other = (a, b) if a[0] == "in" else (b, a)
    return ("in", frozenset(ns for ns in inside[1] if allows(other, ns)))


def union(a: Constraint, b: Constraint) -> Constraint:
    """Namespaces that either covers."""
    if "any" in (a[0], b[0]):
        return ("any",)
    if a[0] == b[0] == "in":
        return ("in", a[1] | b[1])
    if a[0] == b[0] == "not":
        left = a[1] & b[1]
    else:
        inside, other = (a, b) if a[0] == "in" else (b, a)
        left = other[1] - inside[1]
    return ("not", left) if left else ("any",)


def is_subset(a: Constraint, b: Constraint) -> bool:
    """Whether ``b`` covers all that ``a`` covers."""
    if b[0] == "any":
        return True
    if a[0] == "any":
        return False
    if a[0] == "in":
        return all(allows(b, ns) for ns in a[1])
    return b[0] == "not" and b[1] <= a[1]


def stricter(a: str, b: str) -> str:
    """How an intersection is checked."""
    return max(a, b, key=STRICTNESS.__getitem__)


def laxer(a: str, b: str) -> str:
    """How a union is checked."""
    return min(a, b, key=STRICTNESS.__getitem__)


def shown(c: Constraint) -> str:
    return c[0] if c[0] == "any" else f"{c[0]}:{'|'.join(sorted(c[1]))}"
