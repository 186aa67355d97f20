"""SQL expressions of the density formulas, for the oracle."""

from __future__ import annotations

import math

from ..functions.maths import HART_BELOW, HART_TOP


def _horner(z: str, terms) -> str:
    out = f"{terms[0]!r}::DOUBLE"
    for term in terms[1:]:
        out = f"({out}*({z})+{term!r}::DOUBLE)"
    return out


#: Macros that stand before a query; DuckDB keeps them for the statement's WITH by plain substitution.
def cdf(x: str) -> str:
    z = f"abs({x})"
    e = f"exp(-{z}*{z}/2)"
    far = f"{e}/({math.sqrt(2 * math.pi)!r}::DOUBLE*({z}+1/({z}+2/({z}+3/({z}+4/({z}+0.65::DOUBLE))))))"
    tail = f"(CASE WHEN {z}>37 THEN 0 WHEN {z}<7.07106781186547::DOUBLE THEN {e}*{_horner(z, HART_TOP)}/{_horner(z, HART_BELOW)} ELSE {far} END)"
    return f"(CASE WHEN {x}>0 THEN 1-{tail} ELSE {tail} END)"


def pdf(x: str) -> str:
    return f"(exp(-({x})*({x})/2)/{math.sqrt(2 * math.pi)!r}::DOUBLE)"


def nll_gaussian(r: str, s: str) -> str:
    return f"({0.5 * math.log(2 * math.pi)!r}::DOUBLE+ln({s})+({r})*({r})/(2*({s})*({s})))"


def nll_laplace(r: str, s: str) -> str:
    b = f"(({s})/{math.sqrt(2)!r}::DOUBLE)"
    return f"(ln(2*{b})+abs({r})/{b})"


def crps_gaussian(r: str, s: str) -> str:
    w = f"(({r})/({s}))"
    return f"(({s})*({w}*(2*{cdf(w)}-1)+2*{pdf(w)}-{1 / math.sqrt(math.pi)!r}::DOUBLE))"


def crps_laplace(r: str, s: str) -> str:
    b = f"(({s})/{math.sqrt(2)!r}::DOUBLE)"
    return f"({b}*(abs({r})/{b}+exp(-abs({r})/{b})-0.75::DOUBLE))"
