"""Corpus building: cleaning, gating, chat rendering, mixing, budgets, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.ordered import ranges_of, running, shuffle_key, uniform


def cleaned(docs: DataFrame, text_col: str = "text", most: int = T.TEXT_CHARS[1]) -> DataFrame:
    # As the output of a generator the text is computed once, however often later steps refer to it.
    return docs.select("*", F.explode(F.array(T.clean_text(F.col(text_col), most))).alias("clean"))


def judged(docs: DataFrame, text_col: str = "text", least_chars: int = T.TEXT_CHARS[0]) -> DataFrame:
    """Documents with their cleaned text and the reason of the quality gate."""
    split = cleaned(docs, text_col).withColumn("split", T.words(F.col("clean")))
    return split.withColumn("reason", T.quality_reason(F.col("clean"), F.col("split"), least_chars)).drop("split")


def documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that pass the gate, rendered for pre-training."""
    return judged(docs, text_col).where("reason = 'keep'").withColumn("rendered", T.render_document(F.col("clean"))).drop("reason")


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id, rendered`` of conversations with at least one pair, rendered as one sample.

    Turns are folded in order: system turns gather, a user turn replaces one that waits, an
    assistant turn answers the user turn that waits.  The gathered system text goes with the pairs
    up to the first that is rendered.  A conversation is as long as one sample, so it is folded in
    one row.
    """
    state = "struct<system:array<string>,user:string,used:boolean,done:array<string>>"
    clean = turns.select("conv_id", "turn", T.normalise_role(F.col("role")).alias("role"), T.clean_text(F.col("text"), T.CHAT_CHARS[1]).alias("text")).where("text <> ''")
    ordered = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def step(s: Column, m: Column) -> Column:
        # The gathered text is cut to the limit as a whole; its parts are clean.
        system = F.when(s["used"], F.lit("")).otherwise(T.clean_text(F.array_join(s["system"], "\n\n"), T.CHAT_CHARS[1], normalise=False))
        pair = T.render_pair(s["user"], m["text"], system)
        answers = (m["role"] == "assistant") & (s["user"] != "")
        good = answers & (pair != "")
        return F.struct(
            F.when(m["role"] == "system", F.concat(s["system"], F.array(m["text"]))).otherwise(s["system"]).alias("system"),
            F.when(m["role"] == "user", m["text"]).when(answers, F.lit("")).otherwise(s["user"]).alias("user"),
            (s["used"] | good).alias("used"),
            F.when(good, F.concat(s["done"], F.array(F.regexp_replace(pair, r"(?U)\s+\z", "")))).otherwise(s["done"]).alias("done"),
        )

    start = F.struct(F.array().cast("array<string>").alias("system"), F.lit("").alias("user"), F.lit(False).alias("used"), F.array().cast("array<string>").alias("done")).cast(state)
    folded = ordered.select("conv_id", F.aggregate("turns", start, step, lambda s: s["done"]).alias("pairs"))
    whole = folded.where(F.size("pairs") > 0).select("conv_id", F.concat(F.array_join("pairs", "\n"), F.lit(f"\n{T.END_OF_TEXT}\n")).alias("rendered"))
    return whole.where(F.char_length("rendered") <= T.CHAT_CHARS[1])


def message_filter(lang: Column, deleted: Column, review: Column) -> Column:
    """English messages; only a literal true or false in the flags counts, null passes."""
    return lang.eqNullSafe("en") & ~deleted.eqNullSafe(True) & ~review.eqNullSafe(False)


def rank_filter(rank: Column, most: int) -> Column:
    """Ranks up to ``most``; null and what is no number pass."""
    return F.coalesce(F.trim(rank.cast("string")).try_cast("int") <= most, F.lit(True))


def reply_pairs(messages: DataFrame, max_rank: int = 0) -> DataFrame:
    """``pos, rendered`` of answers joined to the prompt that came before them.

    ``messages`` has ``pos, message_id, parent_id, role, text, lang, deleted, review_result, rank``;
    ``pos`` is the order of arrival.  Of prompts with one id the latest before the answer counts.
    """
    good = messages.where(message_filter(F.col("lang"), F.col("deleted"), F.col("review_result")))
    good = good.select("pos", "message_id", "parent_id", T.normalise_role(F.col("role")).alias("role"), T.clean_text(F.col("text"), T.CHAT_CHARS[1]).alias("text"), "rank").where("text <> '' and coalesce(message_id, '') <> ''")
    prompts = good.where("role = 'user'").select(F.col("message_id").alias("parent_id"), F.col("pos").alias("prompt_pos"), F.col("text").alias("prompt"))
    answers = good.where("role = 'assistant'").where(rank_filter(F.col("rank"), max_rank)).select("pos", "parent_id", "text")
    joined = answers.join(prompts, "parent_id").where("prompt_pos < pos")
    latest = joined.groupBy("pos", "text").agg(F.max_by("prompt", "prompt_pos").alias("prompt"))
    return latest.select("pos", T.render_pair(F.col("prompt"), F.col("text"), end=True).alias("rendered")).where("rendered <> ''")


def mix(docs: DataFrame, weights: dict[str, float], source_col: str = "source", id_col: str = "doc_id", seed: int = 1, random: bool = False) -> DataFrame:
    """Documents of weighted sources in one order, ``pos`` from 0.

    Within a source the order is random but repeatable; the k-th document of a source stands at
    k / weight, so sources keep their shares and one that ends leaves the rest to the others.
    With ``random`` the gaps between a source's documents are exponential instead of 1: as these have
    no memory, each place then goes to one of the sources that are left with a chance of its weight,
    as if it were drawn document by document.
    Sources with a weight of 0 or less, or with none, are left out.
    """
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    weighted = docs.withColumn("weight", F.element_at(known, F.col(source_col))).where("weight > 0").withColumn("key", shuffle_key(seed, id_col))
    # A source may hold any share of the rows: its ranks come from ranges of the shuffled order.
    slots = ranges_of(docs)
    # Whole numbers, so that their sums do not depend on the order of adding.
    gap = F.floor(-F.log1p(-uniform(seed + 1, id_col)) * float(1 << 20)) + 1 if random else F.lit(1)
    dealt = weighted.withColumn("slot", F.floor(F.col("key") / float(1 << 52) * slots).cast("int")).withColumn("gap", gap.cast("long"))
    counts = dealt.groupBy(source_col, "slot").agg(F.sum("gap").alias("n"))  # sources x slots rows
    upto = W.partitionBy(source_col).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(source_col, "slot", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("earlier"))
    inside = W.partitionBy(source_col, "slot").orderBy("key", id_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = dealt.withColumn("row", F.sum("gap").over(inside)).join(offsets, [source_col, "slot"])
    strided = ranked.withColumn("stride", (F.col("earlier") + F.col("row")) / F.col("weight")).drop("row", "earlier", "slot", "gap", "key", "weight")
    return running(strided, "stride", ties=(source_col,)).drop("before", "stride")


def budget(rows: DataFrame, target: int, length: Column, order: str = "pos") -> DataFrame:
    """Rows in order until their lengths reach ``target``; the last may go beyond it.  Adds ``chars_before``."""
    ranked = running(rows.withColumnRenamed(order, "_order"), "_order", length).drop("pos").withColumnRenamed("_order", order)
    return ranked.where(F.col("before") < target).withColumnRenamed("before", "chars_before")


def split_name(id_col: str, seed: int = 42, fraction: float = 0.01) -> Column:
    """``val`` for a repeatable share of the ids, else ``train``; independent of the order of sources."""
    return F.when(uniform(seed, id_col) < fraction, "val").otherwise("train")


def sample_chars(text: Column) -> Column:
    """Characters a sample counts for: its stripped text and one line end."""
    return F.char_length(T.strip(text)) + 1


def milestones(rows: DataFrame, length: Column, every: int, order: str) -> DataFrame:
    """Rows with which the running total passes a multiple of ``every``: ``order``, ``chars``."""
    ranked = running(rows.withColumn("_length", length), order, F.col("_length"))
    after = F.col("before") + F.col("_length")
    return ranked.where(F.floor(after / every) > F.floor(F.col("before") / every)).select(order, after.alias("chars"))


def stratified(rows: DataFrame, label: str, per_class: int, id_col: str, seed: int = 42) -> DataFrame:
    """``per_class`` random rows of each class without replacement, repeatable.

    The smallest random keys are found slot by slot before the class is ranked as a whole, so
    that no task sorts more than one slot of a class.
    """
    keyed = rows.withColumn("_key", shuffle_key(seed, id_col)).withColumn("_slot", F.col("_key") % ranges_of(rows))
    few = keyed.withColumn("_rank", F.row_number().over(W.partitionBy(label, "_slot").orderBy("_key", id_col))).where(F.col("_rank") <= per_class)
    return few.withColumn("_rank", F.row_number().over(W.partitionBy(label).orderBy("_key", id_col))).where(F.col("_rank") <= per_class).drop("_rank", "_slot", "_key")


def epoch(rows: DataFrame, id_col: str, size: int, seed: int) -> DataFrame:
    """A random permutation cut into batches of ``size``, the last possibly short: adds ``batch``."""
    ranked = running(rows.withColumn("_key", shuffle_key(seed, id_col)), "_key", ties=(id_col,))
    return ranked.withColumn("batch", F.floor(F.col("pos") / size)).drop("_key", "before", "pos")
