"""Mixing to target weights with soft domain membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import texts
from eventloom.llm.quality import SubwordModel, labelled_sample, posteriors, scored_rows
from eventloom.session import cut_lineage


def rate_after(history: list[list[float]], step: float, pull: float) -> Column:
    """A document's rate after the projected steps whose domain errors are ``history``.

    Every step moves the rate by the gradient for this document, its posterior times the errors and
    the pull back to 1, and cuts it at 0. The rate depends on the posterior and the errors alone, so
    no table of rates is kept between steps.
    """
    if not history:
        return F.lit(1.0)
    errors = F.array(*[F.array(*[F.lit(float(e)) for e in row]) for row in history])

    def move(rate: Column, row: Column) -> Column:
        product = F.aggregate(F.zip_with("p", row, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
        return F.greatest(F.lit(0.0), rate - step * (product + pull * (rate - 1.0)))

    return F.aggregate(errors, F.lit(1.0), move)


def fit_rates(members: DataFrame, targets: list[float], pull: float = 0.01, tolerance: float = 1e-4, most_steps: int = 60) -> list[list[float]]:
    """Nonnegative rates by projected gradient on least squares; returns the errors of every step.

    ``members`` has (tokens, p). With ``A_d = sum(rate * tokens * p_d)``, ``T`` all tokens and ``s_d`` the
    share of the domain at rate 1, the objective is
    ``sum_d (A_d / T - target_d)^2 / (2 s_d) + pull / 2 * sum(tokens / T * (rate - 1)^2)``. The gradient is
    taken in the token-weighted product, where the largest curvature is 1 + pull, and near 1 in every
    direction when posteriors are sharp. A step is one aggregation over all rows and sends the driver
    one number for each domain. It ends when no error moves by more than ``tolerance``; without tokens
    nothing is to be fitted, and a domain without tokens takes no part.
    """
    n, step, history = len(targets), 1 / (1 + pull), []
    share: list[float] = []
    for _ in range(most_steps):
        rate = rate_after(history, step, pull)
        sums = [F.sum("tokens").alias("total"), *[F.sum(rate * F.col("tokens") * F.col("p")[d]).alias(f"a{d}") for d in range(n)]]
        got = members.agg(*sums).first()
        if not got[0]:
            return history
        now = [a / got[0] for a in got[1:]]
        share = share or now
        history.append([(x - t) / s if s > 0 else 0.0 for x, t, s in zip(now, targets, share)])
        if len(history) > 1 and max(abs(a - b) for a, b in zip(history[-1], history[-2])) < tolerance:
            break
    return history


def domain_model(docs: DataFrame, labels: DataFrame, n_domains: int, per_class: int = 2000) -> tuple[SubwordModel, Column]:
    """A subword classifier of the domains 0 .. ``n_domains`` - 1 from (doc_id, cls) labels, and its p over all domains.

    Learned from a bounded sample. A domain without labelled texts has posterior 0; without any the
    posteriors are even.
    """
    rows = labelled_sample(docs, labels.filter(F.col("cls").between(0, n_domains - 1)), per_class, 1 << 16)
    present = sorted({c for _, c in rows})
    if not present:
        return SubwordModel(n_domains), F.col("p")
    model = SubwordModel(len(present)).fit([(text, present.index(c)) for text, c in rows], epochs=8)
    return model, F.array(*[F.col("p")[present.index(d)] if d in present else F.lit(0.0) for d in range(n_domains)])


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: list[float], id_col: str = "doc_id", text_col: str = "text", per_class: int = 2000,
                 pull: float = 0.01) -> DataFrame:
    """Rates with which documents enter a mix whose expected tokens in each domain match ``targets``.

    ``labels`` has (doc_id, cls), the domain (0, 1, ...) of some documents; a classifier trained on a
    bounded sample of them gives every document a posterior over the domains. ``targets`` are the
    weights of the domains, made to sum to 1. Returns doc_id, tokens (white-space words), p (posterior),
    rate (expected copies) and copies (the rate rounded up or down by a hash of the identifier, right on
    average). Null and empty texts have no tokens: they cannot move the totals, and their rate follows
    their posterior. Repeated rows get the same rate. An empty table gives no rows.
    """
    own = texts(docs, id_col, text_col)
    model, p = domain_model(own, labels, len(targets), per_class)
    members = cut_lineage(posteriors(own, model).withColumn("p", p).withColumnRenamed("n_words", "tokens"))
    history = fit_rates(members, [t / sum(targets) for t in targets], pull)
    return members.withColumn("rate", rate_after(history, 1 / (1 + pull), pull)).withColumn("copies", copies_of(F.col("doc_id"), F.col("rate"))).select(
        "doc_id", "tokens", "p", "rate", "copies"
    )


def copies_of(id_col: Column, rate: Column) -> Column:
    """The rate rounded at a threshold drawn from the identifier."""
    return F.floor(rate + (F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) + 0.5) / (1 << 20))


def mixed(docs: DataFrame, labels: DataFrame, targets: list[float], pull: float = 0.01, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) as often as their rate says, with the same columns.

    The domains are learned from the labelled rows of ``learn_from`` (by default ``docs``): where stages
    before have removed most of a domain, the whole table still shows what it looks like.
    """
    own = texts(docs)
    model, p = domain_model(own if learn_from is None else texts(learn_from), labels, len(targets))
    members = posteriors(own, model).select(F.col("n_words").alias("tokens"), p.alias("p"))
    history = fit_rates(cut_lineage(members), [t / sum(targets) for t in targets], pull)
    scored, back = scored_rows(docs, model)
    identifier = F.col(f"c{docs.columns.index('doc_id')}__")
    copies = copies_of(identifier, rate_after(history, 1 / (1 + pull), pull)).cast("int")
    times = scored.withColumn("p", p).withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return times.select(*back)
