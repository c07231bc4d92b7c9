"""What a study swaps into a plan: predicates, methods (null models) and desynchronisations, each a name and a relation.

A predicate is a condition on cells. A method is a relation (field, cell, nr, null_n), from whatever the plan has; its residuals and AUCs follow. A
desynchronisation is a relation of raw slices; its cells, nulls and residuals follow. Those of the library are registered here in the same way as a user's own.
"""

from __future__ import annotations

from polyvane.operators.counts import add_counts
from polyvane.operators.evaluate import PREDICATES, add_evaluation
from polyvane.operators.infer import add_cells, add_residuals
from polyvane.operators.nulls import add_nulls
from polyvane.operators.polyphony import add_slices
from polyvane.plans.dialect import Plan

METHODS: dict[str, str] = {
    "replay": "SELECT field, cell, nr, n0 AS null_n FROM {residuals}",
    "rarity": "SELECT field, cell, nr, null_n FROM {uniform_joined}",
    "pmi": "SELECT field, cell, nr, null_n FROM {independent}",
    "productive": "SELECT field, cell, nr, null_n FROM {productive_joined}",
}
SCHEMES: dict[str, str] = {name: f"SELECT * FROM {{{relation}}}" for name, relation in (
    ("rotation", "rotated"), ("metric", "rotated_metric"), ("phrase", "rotated_phrase"), ("permutation", "permuted"), ("recombination", "recombined"))}
#: Fields between voices, which a desynchronisation is judged by.
VERTICAL = ("V", "O", "H", "S")


def add_methods(plan: Plan, methods: dict[str, str] | None = None, predicates: tuple = tuple(PREDICATES)) -> Plan:
    """{plugged_methods}: (method, atom, n_pos, n_neg, auc) of every method, by every predicate."""
    methods = METHODS if methods is None else methods
    for name, joined in methods.items():
        plan.add(**{f"m{name}_joined": joined})
        add_residuals(plan, f"m{name}_residuals", f"m{name}_joined")
        add_evaluation(plan, f"m{name}_residuals", f"m{name}_", predicates)
    return plan.add(plugged_methods=" UNION ALL ".join(f"SELECT '{name}' AS method, atom, n_pos, n_neg, auc FROM {{m{name}_atom_auc}}" for name in methods))


def add_schemes(plan: Plan, schemes: dict[str, str] | None = None, fields: tuple[str, ...] = VERTICAL, predicates: tuple = tuple(PREDICATES)) -> Plan:
    """{plugged_schemes}: (scheme, atom, auc, real_auc): what the replay null's AUCs come to on every desynchronised corpus, and on the corpus itself."""
    schemes = SCHEMES if schemes is None else schemes
    some = tuple(x for x in predicates if x[1] in fields)
    add_cells(plan, "w_", fields)
    add_evaluation(plan, "w_residuals", "w_", some)
    for k, (name, slices) in enumerate(schemes.items(), start=3):
        p = f"x{k}_"
        plan.add(**{f"scheme_{name}": slices})
        add_slices(plan, p, f"scheme_{name}")
        add_counts(plan, p, rest=False)
        add_nulls(plan, p, rest=False)
        add_cells(plan, p, fields)
        add_evaluation(plan, f"{p}residuals", p, some)
    every = " UNION ALL ".join(f"SELECT '{name}' AS scheme, atom, auc FROM {{x{k}_atom_auc}}" for k, name in enumerate(schemes, start=3))
    return plan.add(plugged_schemes=f"SELECT s.scheme, s.atom, s.auc, r.auc AS real_auc FROM ({every}) s JOIN {{w_atom_auc}} r ON r.atom = s.atom")


PLUGGED = {"plugged_methods": "SELECT method, atom, cast(n_pos AS bigint) AS n_pos, cast(n_neg AS bigint) AS n_neg, round(auc, 6) AS auc FROM {plugged_methods}",
           "plugged_schemes": "SELECT scheme, atom, round(auc, 6) AS auc, round(real_auc, 6) AS real_auc FROM {plugged_schemes}"}
