"""Text accuracy and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numerics import dbl, r6
from ..operators import agreement as ag, bootstrap as bs, chat
from ..operators.ranking import attach_one
from ..operators.staging import staged
from .oracle_views import VIEWS, avg_rank, draws_sql, metrics_sql, r, times_corr, times_rank
from .registry import query

# DuckDB counts bytes, so characters outside ASCII are first mapped one to one to
# single bytes that lower-cased text cannot contain (upper-case letters).
WIDE = "äßçèéêëíñóôöúûüàáâîïùœ"
NARROW = "ABCDEFGHIJKLMNOPQRSTUVW"[:len(WIDE)]
NORM = lambda c: f"trim(regexp_replace(lower(nfc_normalize({c})), '\\s+', ' ', 'g'))"
VIEWS["texts"] = ("text_pairs", f"select pair_id, item_id, engine, tier, {NORM('reference')} as ref, {NORM('hypothesis')} as hyp from text_pairs")
VIEWS["cers"] = ("texts", f"""select *, case when ref = '' and hyp = '' then 0e0 when ref = '' or hyp = '' then 1e0 else levenshtein(translate(ref, '{WIDE}', '{NARROW}'), translate(hyp, '{WIDE}', '{NARROW}'))::double / length(ref) end as cer,
    1e0 + 4e0 * least(1e0, length(hyp) / 5000e0) as mos from texts""")


def texts(t):
    return t.text_pairs.select("pair_id", "item_id", "engine", "tier", tx.normalised(F.col("reference")).alias("ref"), tx.normalised(F.col("hypothesis")).alias("hyp"))


def cers(t):
    rows = texts(t).repartition("pair_id")  # the distance is quadratic in text length: spread the rows first
    rows = rows.select("*", tx.cer(F.col("ref"), F.col("hyp")).alias("cer"), (dbl(1) + dbl(4) * F.least(dbl(1), F.length("hyp") / dbl(5000))).alias("mos"))
    return staged(rows.drop("ref", "hyp"), "cer")


@query("p14_normalised_text", "", f"select doc_id, md5({NORM('text')}) as digest, length({NORM('text')})::int as n from documents")
def p14(t):
    n = tx.normalised(F.col("text"))
    return t.raw("documents").select("doc_id", n.alias("n")).select("doc_id", F.md5("n").alias("digest"), F.length("n").alias("n"))


@query("p15_joined_entities", "", "select conv_id, md5(string_agg(text, ' ' order by turn) filter (trim(text) <> '')) as digest, count(*) filter (trim(text) <> '') as n from conversations group by 1")
def p15(t):
    """Entity texts of a form in id order, blanks dropped (the turns of a conversation)."""
    kept = t.raw("conversations").where(F.trim("text") != "")
    forms = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("e"))
    return forms.select("conv_id", F.md5(F.array_join(F.transform("e", lambda x: x["text"]), " ")).alias("digest"), F.size("e").cast("long").alias("n"))


WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"


@query("p18_word_counts", "", f"select conv_id, sum({WORDS})::bigint + max((role = 'system')::int) * 128 as length, (sum({WORDS}) * case when max((role = 'system')::int) = 1 then 1 else -1 end)::bigint as modality_length from conversations group by 1")
def p18(t):
    """Words per conversation, plus 128 for an image and negative without one; a system turn stands for the image."""
    words = F.aggregate(F.transform("turns", lambda x: tx.word_count(x["value"])), F.lit(0), lambda a, x: a + x).cast("long")
    image = F.exists("turns", lambda x: x["role"] == "system")
    return t.chats.select("conv_id", (words + F.when(image, 128).otherwise(0)).alias("length"), F.when(image, words).otherwise(-words).alias("modality_length"))


@query("r27_cer", "cers", f"select pair_id, {r('cer')} as cer from cers")
def r27(t):
    return cers(t).select("pair_id", r6("cer").alias("cer"))


@query("r27_wer")
def r27w(t):
    return texts(t).repartition("pair_id").select("pair_id", tx.wer(F.col("ref"), F.col("hyp")).alias("wer"))


@query("a7_tier_engine_stats", "cers", f"select tier, engine, count(*) as n, {r('avg(cer)')} as cer_mean, {r('stddev_pop(cer)')} as cer_std, {r('avg(mos)')} as mos_mean, {r('stddev_pop(mos)')} as mos_std from cers group by 1, 2")
def a7(t):
    stats = [r6(f(c)).alias(f"{c}_{n}") for c in ("cer", "mos") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return cers(t).groupBy("tier", "engine").agg(F.count(F.lit(1)).alias("n"), *stats)


@query("a29_tier_means", "cers", f"select tier, {r('avg(mos)')} as mean_mos, count(*) as n from cers group by 1")
def a29(t):
    return cers(t).groupBy("tier").agg(r6(F.avg("mos")).alias("mean_mos"), F.count(F.lit(1)).alias("n"))


VIEWS["master"] = ("cers", "select item_id, tier, engine, avg(cer) as cer, avg(mos) as mos, count(*) as n from cers group by 1, 2, 3")


def master(t):
    return cers(t).groupBy("item_id", "tier", "engine").agg(F.avg("cer").alias("cer"), F.avg("mos").alias("mos"), F.count(F.lit(1)).alias("n"))


@query("j11_text_master", "master", f"select item_id, tier, engine, {r('cer')} as cer, {r('mos')} as mos from master")
def j11(t):
    """Nested record per text and tier with a map by engine, read back in long form."""
    entry = F.struct("engine", F.struct("cer", "mos"))
    nested = master(t).groupBy("item_id", "tier").agg(F.map_from_entries(F.collect_list(entry)).alias("ocr"))
    return nested.select("item_id", "tier", F.explode("ocr").alias("engine", "x")).select("item_id", "tier", "engine", r6("x.cer").alias("cer"), r6("x.mos").alias("mos"))


ORIGINAL = "en"
VIEWS["deltas"] = ("master", f"select b.item_id, b.engine, b.tier, b.cer - a.cer as dc, b.mos - a.mos as dm from master a join master b on a.item_id = b.item_id and a.engine = b.engine where a.tier = '{ORIGINAL}' and b.tier <> '{ORIGINAL}'")


def deltas(t):
    """Difference of every tier to the original tier of the same text and engine."""
    m = staged(master(t), "master")
    base = m.where(F.col("tier") == ORIGINAL).select("item_id", "engine", F.col("cer").alias("c0"), F.col("mos").alias("m0"))
    return m.where(F.col("tier") != ORIGINAL).join(base, ["item_id", "engine"]).select("item_id", "engine", "tier", (F.col("cer") - F.col("c0")).alias("dc"), (F.col("mos") - F.col("m0")).alias("dm"))


@query("j12_paired_deltas", "deltas", f"select item_id, engine, tier, {r('dc')} as delta_cer, {r('dm')} as delta_mos from deltas")
def j12(t):
    return deltas(t).select("item_id", "engine", "tier", r6("dc").alias("delta_cer"), r6("dm").alias("delta_mos"))


PAIRS = (("en", "fr"), ("fr", "de"), ("de", "es"))
VIEWS["tier_pairs"] = ("master", " union all ".join(f"select '{a}' as tier_a, '{b}' as tier_b, x.engine, round(y.cer - x.cer, 9) as d from master x join master y on x.item_id = y.item_id and x.engine = y.engine where x.tier = '{a}' and y.tier = '{b}'" for a, b in PAIRS))


def tier_pairs(t):
    m = staged(master(t), "master")
    parts = [m.where(F.col("tier") == a).alias("x").join(m.where(F.col("tier") == b).alias("y"), ["item_id", "engine"]).select(
        F.lit(a).alias("tier_a"), F.lit(b).alias("tier_b"), "engine", F.round(F.col("y.cer") - F.col("x.cer"), 9).alias("d")) for a, b in PAIRS]
    return staged(parts[0].union(parts[1]).union(parts[2]), "pairs")


PAIR_KEYS = ["engine", "tier_a", "tier_b"]


@query("r18_wilcoxon", "tier_pairs", f"""select engine, tier_a, tier_b, n, case when n >= 5 then {r('coalesce(s, 0e0)', 3)} end as statistic, case when n >= 5 then {r('md')} end as mean_difference
        from a left join w using (engine, tier_a, tier_b)""",
       a="select engine, tier_a, tier_b, count(*) as n, avg(d) as md from tier_pairs group by 1, 2, 3",
       w=f"select engine, tier_a, tier_b, coalesce(sum(rk) filter (d > 0), 0e0) as s from (select *, {avg_rank('abs(d)', 'engine, tier_a, tier_b')} as rk from tier_pairs where d <> 0) group by 1, 2, 3")
def r18(t):
    w = ag.wilcoxon_greater(tier_pairs(t), "d", PAIR_KEYS)
    return w.select(*PAIR_KEYS, "n", r6("statistic", 3).alias("statistic"), r6("mean_difference").alias("mean_difference"))


@query("r18_wilcoxon_p")
def r18p(t):
    return ag.wilcoxon_greater(tier_pairs(t), "d", PAIR_KEYS).select(*PAIR_KEYS, "p_value")


@query("r24_cer_correlation", "cers deltas", f"select 'raw' as kind, engine, n, {r('srcc')} as srcc, {r('plcc')} as plcc from ({metrics_sql('(select engine, round(cer, 9) as cer, mos from cers)', 'cer', 'mos', 'engine')}) where n >= 3 union all select 'delta', engine, n, {r('srcc')}, {r('plcc')} from ({metrics_sql('(select engine, round(dc, 9) as dc, round(dm, 9) as dm from deltas)', 'dc', 'dm', 'engine')}) where n >= 3")
def r24(t):
    nine = lambda df, x, y: staged(df.select("engine", F.round(x, 9).alias("x"), F.round(y, 9).alias("y")), "r24")
    parts = []
    for kind, rows in (("raw", nine(cers(t), "cer", "mos")), ("delta", nine(deltas(t), "dc", "dm"))):
        m = ag.metrics(rows, "x", "y", ["engine"]).where("n >= 3")
        parts.append(m.select(F.lit(kind).alias("kind"), "engine", "n", r6("srcc").alias("srcc"), r6("plcc").alias("plcc")))
    return parts[0].unionByName(parts[1])


REPS = 1000
VIEWS["targets"] = ("cers", "select 'cer' as target, pair_id, mos, round(cer, 9) as y from cers union all select 'cer ' || engine, pair_id, mos, round(cer, 9) from cers union all select 'length', pair_id, mos, length(hyp)::double from cers")


@query("r26_score_against_targets", "targets", " union all ".join(f"""select target, '{c}' as coefficient, max(n) as n, count({c}) filter (rep > 0) as draws, {r(f'max({c}) filter (rep = 0)')} as point,
        {r(f'quantile_cont({c}, 0.025) filter (rep > 0)')} as ci_low, {r(f'quantile_cont({c}, 0.975) filter (rep > 0)')} as ci_high from bm group by 1 having max(n) >= 30 and count({c}) filter (rep > 0) >= 30""" for c in ("srcc", "plcc")),
       **draws_sql("targets", "target", "pair_id", REPS, "'7'"), bt=f"select target, rep, m, n, mos, y, {times_rank('mos', 'target, rep')} as rx, {times_rank('y', 'target, rep')} as ry from targets join dr using (target, pair_id)",
       bm=f"select target, rep, max(n) as n, {times_corr('rx', 'ry')} as srcc, {times_corr('mos', 'y')} as plcc from bt group by 1, 2")
def r26(t):
    """A score against several targets: error of all texts and of each engine, length; groups of 30 and more."""
    c = texts(t).select("pair_id", F.length("hyp").cast("double").alias("length"))
    rows = cers(t).select("pair_id", "engine", "mos", F.round("cer", 9).alias("cer")).join(c, "pair_id")
    pick = F.inline(F.array(*[F.struct(n.alias("target"), v.alias("y")) for n, v in ((F.lit("cer"), F.col("cer")), (F.concat(F.lit("cer "), "engine"), F.col("cer")), (F.lit("length"), F.col("length")))]))
    long = staged(rows.select("pair_id", "mos", pick), "targets")
    per = bs.resampled(long, "pair_id", ["target"], [], "mos", "y", REPS, 7, errors=True, min_units=30)
    values = staged(per.select("target", "rep", "n", F.inline(F.array(*[F.struct(F.lit(m).alias("coefficient"), F.col(m).alias("value")) for m in ("srcc", "plcc")]))), "values")
    keys = ["target", "coefficient"]
    point = values.where("rep = 0").select(*keys, "n", F.col("value").alias("point"))
    ends = bs.interval(values.where("rep > 0"), "value", keys).where("draws >= 30")
    return point.join(ends, keys).select(*keys, "n", "draws", *[r6(c).alias(c) for c in ("point", "ci_low", "ci_high")])


# ---- conversations ----------------------------------------------------------------------------------------

@query("x25_instructions_to_chat", "", """select b.item_id, case when d.doc_id is null then 1 else 1 end as n_messages, md5(b.text || case when d.text is not null then chr(10) || d.lang else '' end) as asked,
        case when d.quality is null then 1 when d.quality = 1 then 2 else 2 end as n_responses, coalesce(d.quality, -1)::int as tag from benchmark b left join (select doc_id, text, lang, quality from documents left join labels using (doc_id)) d on d.doc_id = b.item_id""")
def x25(t):
    docs = t.raw("documents").join(t.raw("labels"), "doc_id", "left").select(F.col("doc_id").alias("item_id"), "lang", "quality")
    rows = t.raw("benchmark").join(docs, "item_id", "left").select(
        "item_id", F.lit(None).cast("array<struct<p: string, r: string>>").alias("history"), F.col("text").alias("prompt"), F.col("lang").alias("query"), F.lit("ok").alias("response"), (F.col("quality") == 1).alias("tag"), "quality")
    out = chat.instructions_to_chat(rows, tag="tag")
    return out.select("item_id", F.size("messages").alias("n_messages"), F.md5(F.element_at("messages", -1)["content"]).alias("asked"), F.size("responses").alias("n_responses"), F.coalesce("quality", F.lit(-1)).alias("tag"))


VIEWS["conv"] = ("", """select conv_id, max(text) filter (turn = t0 and role = 'system') as system, count(*) filter (not (turn = t0 and role = 'system')) as n,
    bool_and(case when turn = t0 and role = 'system' then true when (turn - t0 - s) % 2 = 0 then role in ('user', 'observation') else role in ('assistant', 'function') end) as ok,
    md5(arg_max(text, turn)) as last from (select *, min(turn) over (partition by conv_id) as t0, max((role = 'system')::int) over (partition by conv_id) as s from conversations) group by 1""")


@query("x26_conversations_to_chat", "conv", """select conv_id, coalesce(md5(nullif(system, '')), '') as system, not (ok and n % 2 = 0 and n > 0) as broken, case when ok and n % 2 = 0 and n > 0 then n - 1 else 0 end::int as n_messages,
        case when ok and n % 2 = 0 and n > 0 then last end as reply from conv""")
def x26(t):
    c = chat.conversations_to_chat(t.chats)
    return c.select("conv_id", F.coalesce(F.md5(F.nullif("system", F.lit(""))), F.lit("")).alias("system"), "broken", F.size("messages").alias("n_messages"),
                    F.md5(F.try_element_at("responses", F.lit(1))["content"]).alias("reply"))


@query("x27_usable_examples", "conv", "select conv_id from conv where ok and n % 2 = 0 and n > 0")
def x27(t):
    return chat.usable_examples(chat.conversations_to_chat(t.chats)).select("conv_id")


@query("x28_packing")
def x28(t):
    examples = chat.usable_examples(chat.conversations_to_chat(t.chats))
    sized = examples.select("conv_id", chat.example_length(examples).alias("words"))
    return chat.pack(sized, "conv_id", "words", 512, buckets=16)
