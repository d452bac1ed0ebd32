"""Glossaries: proposals, pinned terms, and what applies in a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import session
from quire.functions import text as tx
from quire.operators import catalog as cat
from quire.plans import scale


def term_key(term: str | Column = "term") -> Column:
    return tx.fold_case(tx.strip(term))


def worded(proposals: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Proposals with the key of their term and their bare translation; blanks are left out.

    Blanks are told by the raw text: a filter on what is worked out here would work it out a second time.
    """
    kept = proposals.where(F.col("term").rlike(tx.NOT_SPACE) & F.col("translation").rlike(tx.NOT_SPACE))
    bare = kept.select(*scope, tx.strip("term").alias("term"), tx.strip("translation").alias("translation"), "seq")
    return bare.withColumn("term", tx.fold_case("term"))


def first_seen(proposals: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The first rendering of every proposed term as ``_new``, and how often it was proposed as ``_seen``."""
    return worded(proposals, scope).groupBy(*scope, "term").agg(
        F.min_by("translation", "seq").alias("_new"), F.count(F.lit(1)).alias("_seen")
    )


def observe(current: DataFrame, proposals: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Add proposals to a glossary: the first rendering of a term stays, the count goes up.

    ``proposals`` carries ``seq``; blanks are left out. Terms are counted by each task before the
    shuffle, so a term proposed everywhere costs one row per task.
    """
    return _added(current, first_seen(proposals, scope), [*scope, "term"])


def _added(current: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(seen, keys, "full").select(
        *keys, F.coalesce("translation", "_new").alias("translation"), F.coalesce("locked", F.lit(False)).alias("locked"),
        (F.coalesce("count", F.lit(0)) + F.coalesce("_seen", F.lit(0))).alias("count"),
    )


def lock(current: DataFrame, edits: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Pin terms: the latest edit gives the wording, the count is kept."""
    keys = [*scope, "term"]
    last = (
        edits.select(*scope, term_key().alias("term"), tx.strip("translation").alias("translation"), "seq")
        .groupBy(*keys).agg(F.max_by("translation", "seq").alias("_new"))
    )
    pinned = F.col("_new").isNotNull()
    return current.join(last, keys, "full").select(
        *keys, F.coalesce("_new", "translation").alias("translation"),
        F.when(pinned, True).otherwise(F.col("locked")).alias("locked"), F.coalesce("count", F.lit(0)).alias("count"),
    )


def unset(current: DataFrame, terms: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Take terms out of a scope."""
    keys = [*scope, "term"]
    gone = terms.select(*scope, term_key().alias("term")).distinct()
    return current.join(gone, keys, "left_anti")


def prompt_order() -> list[Column]:
    return [F.col("locked").desc(), F.col("count").desc(), F.col("term")]


def resolved_order() -> list[Column]:
    return [F.col("locked").desc(), F.col("inherited"), F.col("count").desc(), F.col("term")]


def ordered(glossary: DataFrame) -> DataFrame:
    return glossary.orderBy(*prompt_order())


def top_terms(terms: DataFrame, by: str, order: Sequence[Column], limit: int | None) -> DataFrame:
    """The terms of each group ranked, all of them or the first ``limit``: then every task keeps its own
    first ones before the shuffle, so a group with most of the rows is no burden."""
    ranked = terms.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked if limit is None else ranked.where(F.col("_rank") <= limit)


def prompt_lines(ranked: DataFrame, by: str) -> DataFrame:
    line = F.concat("term", F.lit(" -> "), "translation")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_rank", line.alias("line")))), lambda t: t["line"])
    return ranked.groupBy(by).agg(F.array_join(lines, "\n").alias("terms"))


def prompt_terms(resolved: DataFrame, limit: int | None = None) -> DataFrame:
    """The terms of a scope as a prompt shows them."""
    return prompt_lines(top_terms(resolved, "leaf", resolved_order(), limit), "leaf")


def scope_terms(glossary: DataFrame, limit: int | None = None) -> DataFrame:
    """The same for glossaries that stand alone, one per scope."""
    return prompt_lines(top_terms(glossary, "scope", prompt_order(), limit), "scope")


def resolve_scoped(leaves: DataFrame, glossary: DataFrame) -> DataFrame:
    """Every term that applies in a folder, the narrowest scope winning.

    All folders meet in the root scope, so the glossary side is copied over salts. The winner is
    a maximum by depth, combined before the shuffle.
    """
    chains = cat.scope_chain(leaves.select(F.col("folder").alias("leaf")), "leaf")
    rows = scale.salted_join(chains, glossary, ["scope"], "leaf", how="inner")
    win = F.max_by(F.struct("translation", "locked", "count", "scope"), "scope_depth")
    return rows.groupBy("leaf", "term").agg(win.alias("_w")).select(
        "leaf", "term", "_w.*", (F.col("_w.scope") != F.col("leaf")).alias("inherited")
    )


def broader(rows: DataFrame, glossary: DataFrame) -> DataFrame:
    """(scope, term, over_scope, over_translation): for each (scope, term) what applies from the nearest
    broader scope that holds the term; rows without one are left out.

    A row meets the terms of the scopes above it by equality of scope and term, so the work grows with
    the rows and the depth of their scopes, not with scopes times terms."""
    above = cat.scope_chain(rows.select("scope", "term").distinct().withColumnRenamed("scope", "_own"), "_own").where("scope <> _own")
    held = glossary.select("scope", "term", "translation")
    nearest = F.max_by(F.struct("scope", "translation"), "scope_depth").alias("_n")
    met = above.join(held, ["scope", "term"]).groupBy(F.col("_own").alias("_scope"), "term").agg(nearest)
    return met.select(F.col("_scope").alias("scope"), "term", F.col("_n.scope").alias("over_scope"), F.col("_n.translation").alias("over_translation"))


def scope_layers(glossary: DataFrame) -> DataFrame:
    """The glossaries of all scopes as one table of the same number of rows: every own term with the
    broader one it overrides, if any. What applies in a scope are its own rows and those of the scopes
    above that no narrower one overrides."""
    return glossary.join(broader(glossary, glossary), ["scope", "term"], "left")


def revealed(glossary: DataFrame, removed: DataFrame) -> DataFrame:
    """(scope, term, over_scope, over_translation) for every term taken out of a scope: what applies there
    afterwards, null where nothing does. ``removed`` is (scope, term)."""
    gone = removed.select("scope", term_key().alias("term")).distinct()
    return gone.join(broader(gone, unset(glossary, gone, ["scope"])), ["scope", "term"], "left")


def scope_tree(scopes: DataFrame) -> DataFrame:
    """(scope, enter, leave) of all scopes and those above them: numbers of a tour of the tree, in which the
    scopes inside a scope are those numbered from ``enter`` to ``leave``."""
    chains = cat.scope_chain(scopes.select("scope").distinct().withColumnRenamed("scope", "_leaf"), "_leaf")
    every = chains.select("scope").distinct()
    # a scope comes right before what it holds
    toured = scale.global_rank(every.withColumn("_key", F.replace("scope", F.lit("/"), F.lit("\u0001"))), ["_key"], "enter")
    inside = cat.scope_chain(every.withColumnRenamed("scope", "_leaf"), "_leaf").groupBy("scope").agg(F.count(F.lit(1)).alias("_held"))
    return toured.join(inside, "scope").select("scope", "enter", (F.col("enter") + F.col("_held") - 1).alias("leave"))


def scope_counts(scopes: DataFrame, glossary: DataFrame) -> DataFrame:
    """(scope, own, inherited): how many terms of its own and of broader scopes apply in each scope.

    A term counts from the broadest scope that holds it, for all scopes inside: it comes in where that
    scope is entered in the tour of the tree and goes out behind it, and a running total along the tour
    is the number of terms that apply. No scope meets the terms of another.
    """
    tree = session.written(scope_tree(scopes.select("scope").union(glossary.select("scope"))), "scope_tree")
    layers = scope_layers(glossary).groupBy("scope").agg(
        F.count(F.lit(1)).alias("own"), F.count_if(F.col("over_scope").isNull()).alias("_fresh")
    )
    placed = session.written(tree.join(layers, "scope", "left").fillna(0, ["own", "_fresh"]), "scope_layers")
    come = placed.select(F.col("enter").alias("at"), F.col("_fresh").alias("v"))
    go = placed.select((F.col("leave") + 1).alias("at"), (-F.col("_fresh")).alias("v"))
    steps = come.unionByName(go).groupBy("at").agg(F.sum("v").alias("v")).withColumn("tour", F.lit(0))
    total = scale.sharded_running_total(steps, ["tour"], "at", "v", "_before").select("at", (F.col("_before") + F.col("v")).alias("_all"))
    wanted = placed.join(scopes.select("scope").distinct(), "scope", "left_semi")
    return wanted.join(total, F.col("enter") == F.col("at")).select("scope", "own", (F.col("_all") - F.col("own")).alias("inherited"))


def scoped_observe(current: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals made in a folder land in that folder's glossary, unless the term applies there
    already; a known term is not counted again. ``proposals`` carries ``leaf``.

    Terms are counted first, a row for each folder and term; what applies there is looked up for those rows."""
    seen = session.written(first_seen(proposals, ["leaf"]), "proposed")
    known = cat.scope_chain(seen.select("leaf", "term"), "leaf").join(current.select("scope", "term"), ["scope", "term"], "left_semi")
    fresh = seen.join(known.select("leaf", "term").distinct(), ["leaf", "term"], "left_anti").withColumnRenamed("leaf", "scope")
    return _added(current, fresh, ["scope", "term"])


def own_vs_inherited(leaves: DataFrame, glossary: DataFrame) -> DataFrame:
    """Own and inherited terms of every folder in which a term applies."""
    counts = scope_counts(leaves.select(F.col("folder").alias("scope")), glossary)
    return counts.where("own + inherited > 0").withColumnRenamed("scope", "leaf")


def affected_decks(homes: DataFrame, edited: DataFrame, hits: DataFrame) -> DataFrame:
    """Decks below an edited scope that use the edited term, with the number of their sentences.

    ``edited`` is (scope, term); ``hits`` has one row per sentence and term.
    """
    # From the hits, which are few for a deck and term, up the deck's own chain of scopes: decks
    # without a sentence that uses the term never come up, and no deck meets every edit of the root.
    counted = hits.groupBy("deck_id", "term").agg(F.count(F.lit(1)).alias("sentences"))
    above = counted.join(cat.scope_chain(homes).select("deck_id", "scope"), "deck_id")
    return above.join(edited.select("scope", "term"), ["scope", "term"], "left_semi").select("deck_id", "term", "sentences").distinct()
