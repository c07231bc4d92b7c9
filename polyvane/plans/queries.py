"""Registered queries of the pattern-discovery engine."""

from __future__ import annotations

from polyvane.functions import cells as C
from polyvane.operators.baselines import add_baselines
from polyvane.operators.counts import add_counts
from polyvane.operators.evaluate import PREDICATES, add_evaluation
from polyvane.operators.export import EXPORT_QUERIES, add_export, add_noise, add_vocabularies
from polyvane.operators.grid import LONG_QUERIES, free_plan
from polyvane.operators.families import FAMILY_QUERIES, add_families
from polyvane.operators.infer import add_calibration, add_cells, add_discoveries, add_residuals, add_rules
from polyvane.operators.ladder import LADDER_QUERIES, add_ladder
from polyvane.operators.lattice import add_lattice, log_linear_null
from polyvane.operators.nulls import add_catalogues, add_nulls
from polyvane.operators.paired import PAIRED_QUERIES, add_paired
from polyvane.operators.polyphony import add_notes, add_slices
from polyvane.operators.replay import add_draw_cats, add_null_draws, add_piece_counts, add_replay, add_simulations
from polyvane.operators.reconstruct import add_reconstruction, compliance, reconstruct
from polyvane.operators.stats import add_stats
from polyvane.operators.resample import DRAWS, half_samples, intervals, scheme_bias
from polyvane.operators.synthetic import truth_all
from polyvane.operators.truth import monte_carlo_truth
from polyvane.operators.transform import add_circular, add_desync
from polyvane.plans import audit
from polyvane.plans.dialect import Plan
from polyvane.plans.plugins import PLUGGED, add_methods, add_schemes

TABLES = ("events", "conversations", "labels")


#: Other catalogues than each voice's own, and parts of the corpus: fitted on the training pieces and counted on those held out.
VARIANTS = {"pooled": {"pooled": True}, "swapped": {"swapped": True}, "holdout": {"part": "hold", "catalogue": "train"}}
#: The queries that are also registered over each of them.
VARIED = {"pooled": ("residuals", "discover_hard", "atom_auc"), "swapped": ("residuals", "discover_hard", "atom_auc"), "holdout": ("residuals", "discover_full", "atom_auc", "completeness", "enrichment")}


def build(part: str | None = None, catalogue: str | None = None, **kind: bool) -> Plan:
    plan = Plan()
    add_notes(plan, part, catalogue)
    add_slices(plan)
    add_counts(plan)
    add_catalogues(plan, **kind)
    add_nulls(plan)
    add_cells(plan)
    add_discoveries(plan)
    add_desync(plan)
    for p, source in (("x_", "rotated"), ("x1_", "rotated1"), ("x2_", "rotated2")):
        add_slices(plan, p, source)
        add_counts(plan, p, rest=False)
        add_nulls(plan, p, rest=False)
        add_cells(plan, p)
        add_discoveries(plan, p, f"{p}residuals", soft_z=None)
    add_calibration(plan)
    add_rules(plan)
    add_cells(plan, "v_", ("V",))
    add_baselines(plan)
    add_lattice(plan)
    add_evaluation(plan)
    add_stats(plan)
    add_paired(plan)
    add_ladder(plan)
    add_families(plan)
    add_circular(plan)
    add_reconstruction(plan)
    add_draw_cats(plan)
    for p in ("", "x_", "x1_", "x2_"):
        add_null_draws(plan, p)
    add_replay(plan)
    add_replay(plan, p="x_")
    add_evaluation(plan, "replay_residuals", "r_")
    add_discoveries(plan, "r_", "replay_residuals")
    add_simulations(plan)
    add_piece_counts(plan)
    add_piece_counts(plan, "x_")
    add_export(plan)
    add_vocabularies(plan)
    add_noise(plan)
    add_schemes(add_methods(plan))
    # the atoms' cells among those that are counted by piece
    for name, source in (("x_hits", "x_piece_counts"), ("piece_hits", "piece_counts"), ("k_hits", "k_piece_counts")):
        counted = f"(SELECT DISTINCT field, cell FROM {{{source}}}) c"
        plan.add(**{name: " UNION ALL ".join(f"SELECT '{a}' AS atom, field, cell FROM {counted} WHERE field = '{f}' AND ({where})" for a, f, _, where in PREDICATES if source != "k_piece_counts" or f == "K")})
    return plan


QUERIES = {"notes": "SELECT piece, voice, i, stop, midi FROM {notes}", "tonic": "SELECT * FROM {tonic}", "slices": "SELECT * FROM {slices}", "pair_steps": "SELECT * FROM {pair_steps}",
           "phrases": "SELECT * FROM {phrases}", "splits": "SELECT * FROM {splits}",
           "catalogue_pitch": "SELECT voice, m, n, round(share, 9) AS share FROM {pitch_cat}", "catalogue_steps": "SELECT voice, d, n, round(share, 9) AS share FROM {dp_cat}",
           **{f"real_{f.lower()}": f"SELECT * FROM {{real_{f.lower()}}}" for f in C.FIELDS},
           **{f"null_{f.lower()}": f"SELECT cell, round(n, 6) AS n FROM {{null_{f.lower()}}}" for f in C.FIELDS},
           "residuals": "SELECT field, cell, nr, round(n0, 6) AS n0, round(rho, 6) AS rho, round(z, 6) AS z FROM {residuals}",
           **{f"replay_{f.lower()}": f"SELECT cell, cast(sum(n) AS bigint) AS n FROM {{replay_{f.lower()}}} GROUP BY cell" for f in C.FIELDS},
           "real_counts": "SELECT * FROM {cells_real}", "null_counts": "SELECT field, cell, round(n, 6) AS n FROM {cells_null}", "piece_counts": "SELECT * FROM {piece_counts}", "replay_counts": "SELECT field, cell, cast(sum(n) AS bigint) AS n FROM {replay_cells} GROUP BY field, cell",
           "replay_residuals": "SELECT field, cell, nr, n0, round(rho, 6) AS rho, round(z, 6) AS z FROM {replay_residuals}", "replay_atom_auc": "SELECT atom, cast(n_pos AS bigint) AS n_pos, cast(n_neg AS bigint) AS n_neg, round(auc, 6) AS auc FROM {r_atom_auc}",
           "pvalues_empirical": "SELECT field, cell, z, round(p_low, 9) AS p_low, round(p_high, 9) AS p_high FROM {empirical}", "empirical_bh": "SELECT polarity, cast(approx AS bigint) AS approx, cast(empirical AS bigint) AS empirical, cast(both_kinds AS bigint) AS both_kinds, round(jaccard, 6) AS jaccard FROM {empirical_bh}",
           "nominal_tails": "SELECT @DOUBLE(tail) AS tail, round(low, 6) AS low, round(high, 6) AS high, n FROM {nominal_tails}",
           "discover_hard": "SELECT * FROM {discover_hard}", "discover_full": "SELECT * FROM {discover_full}", "fixed_rules": "SELECT field, cell, kind, round(rho, 6) AS rho FROM {fixed_rules}",
           "rotated": "SELECT * FROM {rotated}", "rotated_metric": "SELECT * FROM {rotated_metric}", "rotated_phrase": "SELECT * FROM {rotated_phrase}", "permuted": "SELECT * FROM {permuted}", "recombined": "SELECT * FROM {recombined}",
           "calibration": "SELECT @DOUBLE(z_cut) AS z_cut, @DOUBLE(q) AS q, n_false, round(frac, 6) AS frac, chosen FROM {calibration}", "soft_calibration": "SELECT @DOUBLE(soft_z) AS soft_z, cast(eligible AS bigint) AS eligible, cast(adds AS bigint) AS adds, round(frac, 6) AS frac FROM {soft_calibration}",
           "attribution": "SELECT field, cell, polarity, type, round(z_real, 6) AS z_real, round(z_desync, 6) AS z_desync FROM {attribution}", "admission": "SELECT * FROM {admission}", "prohibitions": "SELECT * FROM {prohibitions}",
           "uniform_null": "SELECT field, cell, round(rho, 6) AS rho, round(z, 6) AS z FROM {uniform_residuals}", "circular_null": "SELECT field, cell, nr, n0, round(rho, 6) AS rho, round(z, 6) AS z FROM {circular_residuals}", "independent_null": "SELECT field, cell, round(n0, 6) AS n0, round(z, 6) AS z FROM {independent_residuals}",
           "productive_null": "SELECT field, cell, nr, round(n0, 6) AS n0, round(rho, 6) AS rho, round(z, 6) AS z FROM {productive_residuals}",
           "atom_auc": "SELECT atom, cast(n_pos AS bigint) AS n_pos, cast(n_neg AS bigint) AS n_neg, round(auc, 6) AS auc FROM {atom_auc}", "precision_at_k": "SELECT polarity, k, round(precision, 6) AS precision, round(base, 6) AS base FROM {precision_at_k}",
           "atom_cells": "SELECT * FROM {hits}",
           "enrichment": "SELECT polarity, cast(n_found AS bigint) AS n_found, round(precision, 6) AS precision, round(base, 6) AS base, round(lift, 6) AS lift FROM {enrichment}", "completeness": "SELECT * FROM {completeness}",
           "random_discovery": "SELECT draw, round(completeness, 6) AS completeness FROM {random_discovery}", "empty_false": "SELECT n, cast(uncovered AS bigint) AS uncovered FROM {empty_false}", "rarity_rank": "SELECT * FROM {rarity_rank}",
           "flagship": "SELECT cell, nr, round(n0, 6) AS n0, round(rho, 6) AS rho, round(z, 6) AS z FROM {v_residuals} ORDER BY z, cell LIMIT 20",
           "melodic_deltas": "SELECT * FROM {deltas}", "figures": "SELECT * FROM {figures}", "exchanges": "SELECT * FROM {exchanges}", "motion_counts": "SELECT * FROM {motion_counts}", "imitation": "SELECT piece, va, vb, lag, round(r, 4) AS r FROM {imitation}",
           "piece_stats": "SELECT piece, tonic, mode, lowest, highest, round(mean_pitch, 6) AS mean_pitch, round(sounding, 6) AS sounding, round(sync, 6) AS sync FROM {piece_stats}", "geometry_fire": "SELECT * FROM {geometry}",
           "markov_nll": "SELECT model, cast(n AS bigint) AS n, round(nll, 6) AS nll, round(perplexity, 6) AS perplexity FROM {melodic_nll}", "step_tvd": "SELECT va, vb, round(tvd, 6) AS tvd FROM {step_tvd}",
           "halfsample_ci": "SELECT cell, round(low, 6) AS low, round(high, 6) AS high FROM {half_intervals}", "holm": "SELECT field, cell, round(adjusted, 6) AS adjusted FROM {holm}", "critical_z": "SELECT field, @DOUBLE(alpha) AS alpha, tests, kind, round(z, 6) AS z FROM {critical_z}", "kappa": "SELECT a, b, n, round(kappa, 6) AS kappa FROM {kappa}",
           "alpha": "SELECT ratings, round(alpha, 6) AS alpha FROM {alpha}", "wilson": "SELECT quality, n, round(low, 6) AS low, round(high, 6) AS high FROM {wilson}", "role_moves": "SELECT * FROM {role_moves}", "soft_chosen": "SELECT @DOUBLE(soft_z) AS soft_z FROM {soft_chosen}",
           "note_bars": "SELECT piece, voice, i, bar, @DOUBLE(beat) AS beat FROM {note_bars}", "nearest_slices": "SELECT * FROM {nearest_slices}", "note_slices": "SELECT * FROM {note_slices}",
           "degree_marginals": "SELECT voice, mode, degree, round(by_count, 6) AS by_count, round(by_duration, 6) AS by_duration FROM {degree_marginals}",
           "cell_means": "SELECT field, cell, round(mean, 6) AS mean, round(sd_population, 6) AS sd_population, round(sd, 6) AS sd, round(se, 6) AS se FROM {cell_means}", "structure_violations": "SELECT * FROM {structure_violations}",
           **PAIRED_QUERIES, **PLUGGED, **EXPORT_QUERIES, **LADDER_QUERIES, **FAMILY_QUERIES, "recon_starts": "SELECT * FROM {recon_starts}", "recon_steps": "SELECT * FROM {recon_steps}", "recon_ranges": "SELECT * FROM {recon_ranges}"}


def plan(**variant) -> Plan:
    p = build(**variant)
    return p.add(**{f"query_{k}": v for k, v in QUERIES.items()})


def confirmation() -> Plan:
    """Rules found on the training pieces that keep their sign on the pieces held out, against the training pieces' catalogues."""
    both = Plan()
    for side in (build(part="train").renamed("t_"), build(part="hold", catalogue="train").renamed("h_")):
        both.add(**side.nodes).add_forms(**side.forms)
    return both.add(query_confirmed="""SELECT t.field, t.cell, t.kind, round(t.rho, 6) AS rho, round(h.rho, 6) AS hold_rho FROM {t_fixed_rules} t JOIN {h_residuals} h ON h.field = t.field AND h.cell = t.cell
        WHERE t.kind = 'forbid' AND round(h.rho, 9) < 0 OR t.kind = 'prefer' AND round(h.rho, 9) > 0""")


def _named() -> dict[str, tuple[str, dict]]:
    """Registered name -> query, variant."""
    return {k: (k, {}) for k in QUERIES} | {f"{v}_{k}": (k, variant) for v, variant in VARIANTS.items() for k in VARIED[v]}


def loglinear_null(spark, sf_dir):
    """Residuals against the log-linear model of all pairs of bits; iterative, so there is no SQL."""
    tables, p, made = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}, plan(), {}
    add_residuals(p, "fitted_residuals", "fitted")
    p.add(query_fitted="SELECT field, cell, nr, round(n0, 6) AS n0, round(rho, 6) AS rho, round(z, 6) AS z FROM {fitted_residuals}")
    return p.frame("query_fitted", tables | {"fitted": log_linear_null(p.frame("bit_lists", tables, spark, made))}, spark)


def _reconstructed(measured: bool):
    def run(spark, sf_dir):
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
        p, made = plan(), {}
        placed, starts, steps, ranges = (p.frame(x, tables, spark, made) for x in ("placed", "recon_starts", "recon_steps", "recon_ranges"))
        out = reconstruct(placed, starts, steps, ranges, copies=4 if measured else 1)
        return compliance(placed, out) if measured else out

    return run


def _resampled(spark, sf_dir):
    """Counts by piece of the corpus and of its desynchronised copy, and the cells of all atoms in either."""
    tables, p, made = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}, plan(), {}
    counts, shifted, hits, x_hits = (p.frame(x, tables, spark, made) for x in ("piece_counts", "x_piece_counts", "piece_hits", "x_hits"))
    return counts, shifted, hits.unionByName(x_hits), [x[:3] for x in PREDICATES]


def method_gap_ci(spark, sf_dir, draws: int = DRAWS):
    """Four methods scored on 1,000 halves of the pieces: intervals of each and of the differences to the replay null."""
    return intervals(half_samples(*_resampled(spark, sf_dir), draws))


def perturbation_audit(spark, sf_dir):
    """What training pieces were fitted to, before and after the held-out pieces' events are changed."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return audit.perturbed(spark, build(part="train"), tables, tables | {"events": audit.disturb_held_out(tables["events"])})


def resampling_bias(spark, sf_dir):
    """Halves, samples with replacement and doubled corpora beside the point estimate."""
    tables, p, made = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}, plan(), {}
    counts, hits = (p.frame(x, tables, spark, made) for x in ("k_piece_counts", "k_hits"))
    return scheme_bias(counts, counts, hits, [x[:3] for x in PREDICATES])


def queries() -> dict:
    def make(name, built):
        def run(spark, sf_dir):
            tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
            return built().frame(f"query_{name}", tables, spark)

        return run

    known = {k: make(name, lambda variant=variant: plan(**variant)) for k, (name, variant) in _named().items()} | {"confirmed": make("confirmed", confirmation)} | {k: make(k, free_plan) for k in LONG_QUERIES}
    return known | {"synthetic_truth": truth_all, "loglinear_null": loglinear_null,
                    "reconstructed": _reconstructed(False), "reconstruction_gate": _reconstructed(True), "method_gap_ci": method_gap_ci, "resampling_bias": resampling_bias, "perturbation_audit": perturbation_audit, "monte_carlo_truth": monte_carlo_truth}


def flagship(spark, sf_dir: str):
    return queries()["flagship"](spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    plans = {v: plan(**variant) for v, variant in VARIANTS.items()} | {"": plan()}
    return {k: plans[k.split("_")[0] if variant else ""].duck(f"query_{name}") for k, (name, variant) in _named().items()} | {"confirmed": confirmation().duck("query_confirmed")} | {k: free_plan().duck(f"query_{k}") for k in LONG_QUERIES}
