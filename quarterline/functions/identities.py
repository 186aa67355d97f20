"""Accounting items as signed sums of others, and identities that must hold between them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Derived items and their terms, each after those it uses.
DERIVED = {
    "gpq": "+revtq -cogsq",
    "xoprq": "+cogsq +xsgaq",
    "xsgaq_ex_rd": "+xsgaq -xrdq",
    "oibdpq": "+gpq -xsgaq",
    "oiadpq": "+oibdpq -dpq",
    "piq": "+oiadpq -xintq +nopiq +spiq",
    "ibq": "+piq -txtq -miiq",
    "niq": "+ibq +xidoq",
    "intanq": "+gdwlq +intanoq",
    "aoq_ex_intanq": "+aoq -intanq",
    "ppegtq": "+ppentq +dpactq",
    "actq": "+cheq +rectq +invtq +acoq",
    "ancq": "+ppentq +aoq",
    "atq": "+actq +ancq",
    "lctq": "+apq +dlcq +txpq +lcoq",
    "loq_ex_dr": "+loq -drltq",
    "ltq": "+lctq +dlttq +txditcq +loq",
    "ceqq": "+cstkq +capsq +req -tstkq",
    "seqq": "+ceqq +pstkq",
    "wcapq": "+actq -lctq",
    "ivncfq": "-capxq -ivchq -aqcq +sivq +sppeq +ivstchq +ivacoq",
    "fincfq": "+sstkq -prstkcq +dltisq -dltrq +dlcchq -dvq +txbcofq +fiaoq",
    "fcfq": "+oancfq -capxq",
}
# Identities with a sum of zero; the number after the underscore is the lag in quarters.
IDENTITIES = {
    "asset_decomposition": "+cheq_0 +invtq_0 +rectq_0 +acoq_0 +ppentq_0 +aoq_0 -atq_0",
    "asset_structure": "+actq_0 +ancq_0 -atq_0",
    "current_asset_decomposition": "+cheq_0 +invtq_0 +rectq_0 +acoq_0 -actq_0",
    "intangible_in_other_assets": "+intanq_0 +aoq_ex_intanq_0 -aoq_0",
    "intangible_decomposition": "+gdwlq_0 +intanoq_0 -intanq_0",
    "ppe_gross_decomposition": "+ppentq_0 +dpactq_0 -ppegtq_0",
    "liability_decomposition": "+apq_0 +lcoq_0 +dlcq_0 +txpq_0 +dlttq_0 +txditcq_0 +loq_0 -ltq_0",
    "current_liability_decomposition": "+apq_0 +dlcq_0 +txpq_0 +lcoq_0 -lctq_0",
    "other_liabilities_decomposition": "+drltq_0 +loq_ex_dr_0 -loq_0",
    "working_capital": "+wcapq_0 -actq_0 +lctq_0",
    "common_equity_decomposition": "+cstkq_0 +capsq_0 +req_0 -tstkq_0 -ceqq_0",
    "stockholders_equity": "+seqq_0 -pstkq_0 -ceqq_0",
    "accounting_equation": "+atq_0 -ltq_0 -mibtq_0 -seqq_0",
    "gross_profit": "+gpq_0 -revtq_0 +cogsq_0",
    "ebitda": "+oibdpq_0 -gpq_0 +xsgaq_0",
    "ebit": "+oiadpq_0 -oibdpq_0 +dpq_0",
    "pretax_income": "+piq_0 -oiadpq_0 +xintq_0 -nopiq_0 -spiq_0",
    "income_before_extra": "+ibq_0 -piq_0 +txtq_0 +miiq_0",
    "net_income_from_ib": "+niq_0 -ibq_0 -xidoq_0",
    "net_income": "+niq_0 -piq_0 +txtq_0 +miiq_0 -xidoq_0",
    "operating_expenses": "+xoprq_0 -cogsq_0 -xsgaq_0",
    "sga_decomposition": "+xrdq_0 +xsgaq_ex_rd_0 -xsgaq_0",
    "full_income_statement": "+revtq_0 -cogsq_0 -xsgaq_0 -dpq_0 -xintq_0 +nopiq_0 +spiq_0 -txtq_0 -miiq_0 +xidoq_0 -niq_0",
    "investing_cash_flow": "-capxq_0 -ivchq_0 -aqcq_0 +sivq_0 +sppeq_0 +ivstchq_0 +ivacoq_0 -ivncfq_0",
    "financing_cash_flow": "+sstkq_0 -prstkcq_0 +dltisq_0 -dltrq_0 +dlcchq_0 -dvq_0 +fiaoq_0 +txbcofq_0 -fincfq_0",
    "free_cash_flow": "+fcfq_0 -oancfq_0 +capxq_0",
}


def parse_term(term: str) -> tuple[float, str, int]:
    """(sign, account, lag) of a term like -atq_0."""
    found = re.fullmatch(r"([+-])(.+)_([0-9-]+)", term)
    if not found:
        raise ValueError(f"not a signed term: {term}")
    return (1.0 if found[1] == "+" else -1.0), found[2], int(found[3])


def parse_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """The same for a column of terms; what doesn't parse gives nulls."""
    pattern = r"^([+-])(.+)_([0-9-]+)$"
    part = lambda k: F.nullif(F.regexp_extract(column, pattern, k), F.lit(""))
    return terms.withColumns({"sign": F.when(part(1) == "+", 1.0).when(part(1) == "-", -1.0), "account": part(2), "lag": part(3).cast("int")})


def derive(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Adds all derived items. Missing primitives count as 0, or with strict make null whatever uses them."""
    known: dict[str, Column] = {c: F.col(c).cast("double") for c in rows.columns if not strict or c not in DERIVED}
    out: dict[str, Column] = {}
    for item, terms in DERIVED.items():
        total = None
        for term in terms.split():
            value = out.get(term[1:], known.get(term[1:], F.lit(None).cast("double")))
            value = value if strict else F.coalesce(value, F.lit(0.0))
            value = value if term[0] == "+" else -value
            total = value if total is None else total + value
        out[item] = total
    return rows.withColumns(out)


def residuals(wide: DataFrame, keys: list[str], identities: dict[str, str]) -> DataFrame:
    """Signed sum of each identity over the accounts of a row; identities with an account that is null or absent are left out."""
    sums = []
    for name, terms in identities.items():
        parsed = [parse_term(t) for t in terms.split()]
        if all(a in wide.columns for _, a, _ in parsed):
            sums.append(F.struct(F.lit(name).alias("identity"), sum((F.col(a) * s for s, a, _ in parsed), F.lit(0.0)).alias("residual")))
    return wide.select(*keys, F.inline(F.array(*sums))).where(F.col("residual").isNotNull())


def complete(tall: DataFrame, terms: DataFrame, key: str = "firm_id") -> DataFrame:
    """Instances (key, qoff, identity) of which every term is present: relational division by counts.

    tall has key, qoff, account; terms has identity, account, lag. Each row looks up the instances it is part of.
    """
    needed = terms.groupBy("identity").agg(F.count("*").alias("needed"))
    part = tall.select(key, "qoff", "account").join(F.broadcast(terms), "account").select(key, (F.col("qoff") + F.col("lag")).alias("qoff"), "identity", "account", "lag").distinct()
    return part.groupBy(key, "qoff", "identity").agg(F.count("*").alias("held")).join(F.broadcast(needed), "identity").where("held = needed").select(key, "qoff", "identity")


def reconcile(mu: DataFrame, keys: list[str], terms: list[tuple[float, str]]) -> DataFrame:
    """Moves values with variances (columns v_<account>) so that one signed sum is zero, least variances moved least."""
    gap = sum((F.col(a) * s for s, a in terms), F.lit(0.0))
    weight = sum((F.col(f"v_{a}") for _, a in terms), F.lit(0.0))
    share = gap / F.nullif(weight, F.lit(0.0))
    return mu.select(*keys, *[(F.col(a) - F.coalesce(s * F.col(f"v_{a}") * share, F.lit(0.0))).alias(a) for s, a in terms])


def reconcile_many(mu: DataFrame, keys: list[str], accounts: list[str], identities: list[str]) -> DataFrame:
    """The same for several identities at once: W^-1 A' (A W^-1 A')^-1, solved for each batch of rows with NumPy.

    Rows with a null keep their values. A singular system is solved by least squares.
    """
    import numpy as np

    a = np.zeros((len(identities), len(accounts)))
    for k, terms in enumerate(identities):
        for sign, account, _ in map(parse_term, terms.split()):
            a[k, accounts.index(account)] = sign
    v_names = [f"v_{x}" for x in accounts]

    def run(batches):
        for batch in batches:
            x, v = batch[accounts].to_numpy(float), batch[v_names].to_numpy(float)
            good = np.isfinite(x).all(1) & np.isfinite(v).all(1)
            if good.any():
                wa = v[good][:, :, None] * a.T[None]
                system, gap = a[None] @ wa, x[good] @ a.T
                x[good] -= np.einsum("nij,nj->ni", wa, np.einsum("nij,nj->ni", np.linalg.pinv(system), gap))
            batch[accounts] = x
            yield batch[[*keys, *accounts]]

    fields = ", ".join([f"`{k}` {mu.schema[k].dataType.simpleString()}" for k in keys] + [f"`{x}` double" for x in accounts])
    return mu.select(*keys, *accounts, *v_names).mapInPandas(run, fields)
