"""Token corpus queries: rendering, masks, encoding, checks, packing, embeddings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from trajmill import constants as C
from trajmill.functions import arrays as A, text as X
from trajmill.functions.sql import register_sql_functions
from trajmill.operators import chat, embeddings as emb, encode, grades, ordering, pack, verify
from trajmill.plans import views as V
from trajmill.plans.registry import query

MASK_LENGTH = 600
ROW_LENGTH = 4096
NO_CUT = 1 << 30
CAPACITY = 16384
BATCH = 250

# --- conversations as turn tables -------------------------------------------------------


def _segments(spark, sf):
    return chat.turn_segments(V.conversations(spark, sf), "conv_id", "turn", "role", "text")


def _spans(spark, sf):
    return chat.turn_spans(V.conversations(spark, sf), "conv_id", "turn", "role", F.octet_length("text"))


def _masks(spark, sf, max_length=NO_CUT):
    return chat.conversation_masks(_spans(spark, sf), "conv_id", "turn", max_length)


@query(
    "tok_render_chat",
    "SELECT conv_id, turn, target, CAST(strlen(segment) AS BIGINT) AS n_bytes, md5(segment) AS segment_md5 FROM turns",
    "turns",
)
def _(spark, sf):
    return _segments(spark, sf).select(
        "conv_id", "turn", "target",
        F.octet_length("segment").cast("bigint").alias("n_bytes"),
        F.md5(F.col("segment").cast("binary")).alias("segment_md5"),
    )


@query("win_mask_spans", "SELECT conv_id, turn, target, span_start, span_len FROM spans", "spans")
def _(spark, sf):
    return _spans(spark, sf).select("conv_id", "turn", "target", "span_start", "span_len")


# Neighbouring spans of one flag as one run.
_RUNS = """
    flags AS (SELECT conv_id, span_start, span_len AS len, CAST(target AS INTEGER) AS value FROM spans WHERE span_len > 0),
    changes AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY conv_id ORDER BY span_start) THEN 0 ELSE 1 END AS fresh FROM flags),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY span_start) AS island FROM changes)"""


@query(
    "tok_completion_mask",
    f"""SELECT conv_id, CAST(max(cum_len) AS BIGINT) AS orig_len, CAST(least(max(cum_len), {MASK_LENGTH}) AS BIGINT) AS n_ids,
               CAST(COALESCE(sum(greatest(0, least(span_len, {MASK_LENGTH} - span_start))) FILTER (WHERE target), 0) AS BIGINT) AS n_target
        FROM spans GROUP BY conv_id""",
    "spans",
)
def _(spark, sf):
    return _masks(spark, sf, MASK_LENGTH).select(
        "conv_id",
        "orig_len",
        F.size("completion_mask").cast("bigint").alias("n_ids"),
        F.aggregate("completion_mask", F.lit(0), lambda a, m: a + m).cast("bigint").alias("n_target"),
    )


@query(
    "win_mask_runs",
    f""", {_RUNS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY min(span_start)) - 1 AS run_no,
        CAST(value AS BIGINT) AS value, CAST(min(span_start) AS BIGINT) AS start, CAST(sum(len) AS BIGINT) AS len
        FROM islands GROUP BY conv_id, island, value""",
    "spans",
)
def _(spark, sf):
    runs = _masks(spark, sf).select("conv_id", F.posexplode(A.mask_runs(F.col("completion_mask"))).alias("k", "r"))
    return runs.select(
        "conv_id",
        F.col("k").cast("bigint").alias("run_no"),
        F.col("r.value").cast("bigint").alias("value"),
        F.col("r.start").cast("bigint").alias("start"),
        F.col("r.len").cast("bigint").alias("len"),
    )


@query(
    "agg_token_stats",
    """SELECT count(*) AS n_rows, round(avg(n), 6) AS avg_len, min(n) AS min_len, max(n) AS max_len, round(avg(u), 6) AS avg_unmasked,
               round(avg(u) / greatest(avg(n), 1) * 100, 6) AS unmasked_pct FROM (
          SELECT conv_id, max(cum_len) AS n, COALESCE(sum(span_len) FILTER (WHERE target), 0) AS u
          FROM spans GROUP BY conv_id)""",
    "spans",
)
def _(spark, sf):
    unmasked = F.aggregate("completion_mask", F.lit(0), lambda a, m: a + m)
    stats = pack.stats_of_lengths(_masks(spark, sf), "conv_id", F.size("completion_mask"), unmasked)
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_len", "avg_unmasked", "unmasked_pct")}).withColumns(
        {c: F.col(c).cast("bigint") for c in ("min_len", "max_len")}
    )


@query(
    "agg_steps_plan",
    """SELECT count(*) AS n_packs, (count(*) + 7) // 8 AS steps, (count(*) + 7) // 8 * 524288 AS tokens
       FROM (SELECT DISTINCT conv_id FROM conversations)""",
)
def _(spark, sf):
    return grades.steps_plan(_masks(spark, sf))


# --- trajectory rows -------------------------------------------------------------------


def _rows(spark, sf):
    """Three messages per row: the body, the patch as the answer, and the language as a reply."""
    rows = V.traj_rows(spark, sf, heavy=True)
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.select(
        "row_id", F.array(turn("user", F.col("body")), turn("assistant", F.col("patch")), turn("user", F.col("model"))).alias("messages")
    )


def _tokens(spark, sf, max_length=NO_CUT):
    return encode.tokenize_rows(_rows(spark, sf), encode.ByteEncoder(), max_length)


# Byte positions of the three turns; the header of 22 bytes moves to the turn before an answer.
_ROW_SQL = f"""
    text AS (SELECT row_id, '<|im_start|>user' || chr(10) || body || '<|im_end|>' || chr(10) AS ask,
                    '<|im_start|>assistant' || chr(10) AS header, patch || '<|im_end|>' || chr(10) AS answer,
                    '<|im_start|>user' || chr(10) || model || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS reply
             FROM traj_rows),
    sizes AS (SELECT row_id, strlen(ask || header) AS a, strlen(ask || header || answer) AS b,
                     strlen(ask || header || answer || reply) AS total FROM text),
    cut AS (SELECT row_id, total, least(total, {ROW_LENGTH}) AS n, least(b, {ROW_LENGTH}) - least(a, {ROW_LENGTH}) AS u FROM sizes),
    whole AS (SELECT row_id, total AS n, b - a AS u FROM sizes)"""


@query("tok_render_rows", f", {_ROW_SQL} SELECT row_id, md5(ask || header || answer || reply) AS text_md5 FROM text", "traj_rows")
def _(spark, sf):
    text = chat.render(F.col("messages"), generation=True)
    return _rows(spark, sf).select("row_id", F.md5(text.cast("binary")).alias("text_md5"))


@query(
    "tok_completion_mask_rows",
    f""", {_ROW_SQL} SELECT row_id, CAST(total AS BIGINT) AS orig_len, CAST(n AS BIGINT) AS n_ids, CAST(u AS BIGINT) AS n_target FROM cut""",
    "traj_rows",
)
def _(spark, sf):
    return _tokens(spark, sf, ROW_LENGTH).select(
        "row_id",
        F.col("orig_len").cast("bigint").alias("orig_len"),
        F.get("seq_lengths", F.lit(0)).cast("bigint").alias("n_ids"),
        A.masked_count(F.col("mask_runs")).cast("bigint").alias("n_target"),
    )


@query(
    "tok_verify",
    f""", {_ROW_SQL} SELECT row_id, TRUE AS lengths_equal, TRUE AS boundaries_clean,
        CAST(1 AS BIGINT) AS n_end_targets FROM whole""",
    "traj_rows",
)
def _(spark, sf):
    """The last byte of an answer is a line feed, which plays the end token."""
    return verify.verify_tokens(_tokens(spark, sf), 10).select(
        "row_id", "lengths_equal", "boundaries_clean", F.col("n_end_targets").cast("bigint").alias("n_end_targets")
    )


_SOUND = "row_id % 7 > 3"


@query(
    "tok_verify_damaged",
    f""", {_ROW_SQL} SELECT row_id, row_id % 7 <> 1 AS lengths_equal, row_id % 7 <> 1 AS boundaries_clean,
            CAST(CASE row_id % 7 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS n_end_targets, {_SOUND} AS text_equal,
            CAST(CASE WHEN {_SOUND} THEN -1 WHEN row_id % 7 = 3 THEN 1 ELSE 0 END AS BIGINT) AS first_bad_run,
            CASE WHEN {_SOUND} THEN 'none' WHEN row_id % 7 = 3 THEN 'target' ELSE 'prompt' END AS bad_kind FROM whole""",
    "traj_rows",
)
def _(spark, sf):
    """Four rows in seven are damaged: the answer masked, an id lost, a boundary moved, an id changed."""
    rows = _rows(spark, sf).select("row_id", verify.rendered_pieces(F.col("messages")).alias("pieces"), "messages")
    tokens = encode.tokenize_rows(rows, encode.ByteEncoder(), NO_CUT)
    answer, kind = F.get("mask_runs", F.lit(0))["len"], F.col("row_id") % 7
    ids, mask = F.col("input_ids"), F.col("completion_mask")

    def put(values, at, value):
        """``values`` with another value at a place, counted from 0."""
        return F.concat(F.slice(values, 1, at), F.array(value.cast("int")), F.slice(values, at + 2, F.size(values)))

    bad_ids = F.when(kind == 1, F.concat(F.slice(ids, 1, 4), F.slice(ids, 6, F.size(ids)))).when(kind == 3, put(ids, answer, F.get(ids, answer) + 1))
    bad_mask = F.when(kind == 0, F.transform(mask, lambda _: F.lit(0))).when(kind == 2, put(mask, answer - 1, F.lit(1)))
    damaged = tokens.select("row_id", "pieces", F.coalesce(bad_ids, ids).alias("input_ids"), F.coalesce(bad_mask, mask).alias("completion_mask"))
    checked = verify.verify_text(verify.verify_tokens(damaged, 10), "pieces", encode.ByteEncoder())
    return checked.select(
        "row_id", "lengths_equal", "boundaries_clean", F.col("n_end_targets").cast("bigint").alias("n_end_targets"), "text_equal",
        F.coalesce("first_bad_run", F.lit(-1)).cast("bigint").alias("first_bad_run"), F.coalesce("bad_kind", F.lit("none")).alias("bad_kind"),
    )


@query(
    "win_boundary_check",
    f""", {_ROW_SQL} SELECT row_id, TRUE AS clean_line_feed, FALSE AS clean_other FROM whole""",
    "traj_rows",
)
def _(spark, sf):
    """A wrong end token is noticed, as another run follows every answer."""
    ids, runs = F.col("input_ids"), F.col("mask_runs")
    return _tokens(spark, sf).select(
        "row_id", A.boundaries_clean(ids, runs, 10).alias("clean_line_feed"), A.boundaries_clean(ids, runs, 62).alias("clean_other")
    )


@query(
    "agg_target_counts",
    f""", {_ROW_SQL} SELECT row_id, CAST(u AS BIGINT) AS n_targets, CAST(1 AS BIGINT) AS n_end_targets FROM whole""",
    "traj_rows",
)
def _(spark, sf):
    ids, runs = F.col("input_ids"), F.col("mask_runs")
    return _tokens(spark, sf).select(
        "row_id",
        A.masked_count(runs).cast("bigint").alias("n_targets"),
        A.target_count(ids, runs, 10).cast("bigint").alias("n_end_targets"),
    )


@query(
    "arr_truncate",
    f""", {_ROW_SQL} SELECT row_id, CAST(least(n, 100) AS BIGINT) AS n_ids FROM whole""",
    "traj_rows",
)
def _(spark, sf):
    return _tokens(spark, sf).select("row_id", F.size(A.truncate(F.col("input_ids"), 100)).cast("bigint").alias("n_ids"))


@query(
    "arr_split_by_mask",
    f""", {_ROW_SQL} SELECT row_id, CAST(u AS BIGINT) AS n_target, CAST(n - u AS BIGINT) AS n_prompt FROM whole""",
    "traj_rows",
)
def _(spark, sf):
    ids, runs = F.col("input_ids"), F.col("mask_runs")
    return _tokens(spark, sf).select(
        "row_id",
        F.size(A.pick_by_runs(ids, runs, 1)).cast("bigint").alias("n_target"),
        F.size(A.pick_by_runs(ids, runs, 0)).cast("bigint").alias("n_prompt"),
    )


@query(
    "arr_labels",
    f""", {_ROW_SQL} SELECT row_id, CAST(n AS BIGINT) AS n_labels, CAST(n - u AS BIGINT) AS n_ignored,
        CAST(1 AS BIGINT) AS n_chat_labels FROM whole""",
    "traj_rows",
)
def _(spark, sf):
    marks = A.labels(F.col("input_ids"), F.col("mask_runs"))
    rows = _tokens(spark, sf).select("row_id", marks.alias("labels"), A.chat_labels(marks, (10,)).alias("chat"))
    used = lambda c: F.size(F.array_remove(c, C.IGNORED_LABEL))
    return rows.select(
        "row_id",
        F.size("labels").cast("bigint").alias("n_labels"),
        (F.size("labels") - used("labels")).cast("bigint").alias("n_ignored"),
        used("chat").cast("bigint").alias("n_chat_labels"),
    )


@query(
    "tok_decode",
    f""", {_ROW_SQL} SELECT row_id, md5(ask || header || answer || reply) AS text_md5, md5(ask || header || reply) AS prompt_md5,
        md5(answer) AS target_md5 FROM text""",
    "traj_rows",
)
def _(spark, sf):
    views = verify.decoded_views(_tokens(spark, sf), encode.ByteEncoder())
    digest = lambda c: F.md5(F.col(c).cast("binary"))
    return views.select(
        "row_id", digest("text").alias("text_md5"), digest("prompt_text").alias("prompt_md5"), digest("target_text").alias("target_md5")
    )


@query(
    "win_cu_seqlens",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat_ws(',', 0, n_chars % 50 + 1, n_chars % 50 + 3)
                           ELSE concat_ws(',', 0, n_chars % 50 + 1, n_chars % 50 + 1 + doc_id % 3, n_chars % 50 + 3 + doc_id % 3) END AS cu_seqlens,
              CAST((n_chars % 50 + 1) * (n_chars % 50) // 2 + (doc_id % 3) * (doc_id % 3 - 1) // 2 + 1 AS BIGINT) AS position_sum,
              CAST(n_chars % 50 + 3 + doc_id % 3 AS BIGINT) AS n_positions
       FROM documents""",
)
def _(spark, sf):
    """Three members per row; every third row has an empty one in the middle."""
    lengths = F.array(
        (F.col("n_chars") % 50 + 1).cast("int"), (F.col("doc_id") % 3).cast("int"), F.lit(2)
    )
    rows = V.table(spark, sf, "documents").select("doc_id", lengths.alias("seq_lengths"))
    places = A.position_ids(F.col("seq_lengths"))
    return rows.select(
        "doc_id",
        F.array_join(A.cu_seqlens(F.col("seq_lengths")).cast("array<string>"), ",").alias("cu_seqlens"),
        F.aggregate(places, F.lit(0), lambda a, p: a + p).cast("bigint").alias("position_sum"),
        F.size(places).cast("bigint").alias("n_positions"),
    )


# --- encoders ------------------------------------------------------------------------------


@query(
    "tok_encode",
    """SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS n_ids,
              CAST(list_sum(list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::INT)) AS BIGINT) AS id_sum
       FROM conversations""",
)
def _(spark, sf):
    rows = V.conversations(spark, sf).select("conv_id", "turn", "text")
    encoded = encode.encode_column(rows, "text", encode.ByteEncoder())
    return encoded.select(
        "conv_id",
        "turn",
        F.size("input_ids").cast("bigint").alias("n_ids"),
        F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, t: a + t).alias("id_sum"),
    )


def corpus_vocab(spark, sf, words: int = 4096):
    """A rank table from the corpus: all bytes first, then the most frequent words.

    The table is limited by its number of ranks, as a vocabulary is.
    """
    bytes_part = spark.range(256).select(
        F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("token"), F.col("id").cast("int").alias("rank")
    )
    found = (
        V.documents(spark, sf)
        .select(F.explode(F.split("text", " ")).alias("word"))
        .where(F.octet_length("word") > 1)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(words)
    )
    # Ranks number the few thousand words that are left.
    ranked = found.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) + 255).cast("int"))
    return bytes_part.unionByName(ranked.select(F.col("word").cast("binary").alias("token"), "rank"))


@query(
    "tok_encode_ranks",
    """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, TRUE AS shorter, TRUE AS same_text FROM documents""",
)
def _(spark, sf):
    """Byte-pair encoding of every document with a vocabulary of the corpus, and back."""
    encoder = encode.rank_encoder(corpus_vocab(spark, sf))
    docs = V.documents(spark, sf).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("was"), "text"
    )
    ids = encode.encode_column(docs, "text", encoder).withColumn("n_ids", F.size("input_ids"))
    back = encode.decode_columns(ids, {"input_ids": "text"}, encoder)
    return back.select(
        "doc_id", "n_bytes", (F.col("n_ids") <= F.col("n_bytes")).alias("shorter"), (F.md5(F.col("text").cast("binary")) == F.col("was")).alias("same_text")
    )


@query("str_pretokenize", "SELECT doc_id, TRUE AS lossless, length(text) > 0 AS has_pieces FROM documents")
def _(spark, sf):
    docs = V.documents(spark, sf).select("doc_id", "text", X.pretokenize(F.col("text")).alias("p"))
    return docs.select("doc_id", (F.array_join("p", "") == F.col("text")).alias("lossless"), (F.size("p") > 0).alias("has_pieces"))


_TOKENS = list(C.SPECIAL_TOKENS) + ["<|other|>"]


@query(
    "tok_special_lookup",
    "SELECT doc_id, CAST(CASE doc_id % 6 WHEN 5 THEN -1 ELSE 65535 + doc_id % 6 END AS BIGINT) AS token_id FROM documents",
)
def _(spark, sf):
    names = F.array(*map(F.lit, _TOKENS))
    token = F.get(names, (F.col("doc_id") % 6).cast("int"))
    return V.table(spark, sf, "documents").select(
        "doc_id", F.coalesce(A.special_token_id(token), F.lit(-1)).cast("bigint").alias("token_id")
    )


# --- packing ----------------------------------------------------------------------------------


def _plan(spark, sf):
    rows = V.table(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("length"))
    placed = ordering.seeded_position(rows, 0, "doc_id", "position")
    return pack.plan_packs(placed, "doc_id", "length", "position", CAPACITY, BATCH)


_PLACED = f"""(SELECT doc_id, strlen(text) AS n, greatest(1, CAST(ceil(strlen(text) / {CAPACITY}.0) AS BIGINT)) AS pieces,
    (row_number() OVER (ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) // {BATCH} AS batch FROM documents)"""


@query(
    "tok_pack_bfd",
    f"""SELECT batch, CAST(sum(pieces) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS n_tokens, TRUE AS fits, TRUE AS each_row_once, TRUE AS enough_bins,
               TRUE AS well_filled FROM {_PLACED} GROUP BY batch""",
)
def _(spark, sf):
    """The packing plan of every batch with its invariants; documents over the capacity are several rows.

    Well filled: two bins of a batch that together would fit in one do not exist, which
    holds for best fit; so fewer than two bins per capacity of tokens, plus one.
    """
    bins = _plan(spark, sf).groupBy("batch", "bin").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("length").alias("fill"), F.max("slot").alias("last"), F.countDistinct("id").alias("ids")
    )
    return bins.groupBy("batch").agg(
        F.sum("rows").alias("n_rows"),
        F.sum("fill").alias("n_tokens"),
        F.bool_and(F.col("fill") <= CAPACITY).alias("fits"),
        F.bool_and((F.col("ids") == F.col("rows")) & (F.col("last") + 1 == F.col("rows"))).alias("each_row_once"),
        (F.count(F.lit(1)) >= F.ceil(F.sum("fill") / CAPACITY)).alias("enough_bins"),
        (F.count(F.lit(1)) <= F.ceil(F.sum("fill") * 2 / CAPACITY) + 1).alias("well_filled"),
    )


@query(
    "tok_pack_rows",
    f"""SELECT CAST(sum(pieces) AS BIGINT) AS n_members, CAST(sum(n) AS BIGINT) AS n_tokens, TRUE AS sizes_agree, TRUE AS fits FROM {_PLACED}""",
)
def _(spark, sf):
    """Packed rows of the whole corpus: token arrays move once, by pack."""
    docs = V.documents(spark, sf).select("doc_id", "text")
    tokens = encode.encode_column(docs, "text", encode.ByteEncoder()).withColumn(
        "completion_mask", F.array_repeat(F.lit(1), F.size("input_ids"))
    )
    packs = pack.build_packs(tokens, _plan(spark, sf), "doc_id", CAPACITY)
    filled = F.aggregate("seq_lengths", F.lit(0), lambda a, n: a + n)
    return packs.select(
        F.size("seq_lengths").alias("members"), F.size("input_ids").alias("n"), F.size("completion_mask").alias("m"), filled.alias("s")
    ).agg(
        F.sum("members").alias("n_members"),
        F.sum("n").alias("n_tokens"),
        F.bool_and((F.col("n") == F.col("m")) & (F.col("n") == F.col("s"))).alias("sizes_agree"),
        F.bool_and(F.col("n") <= CAPACITY).alias("fits"),
    )


# --- text expressions ---------------------------------------------------------------------------


@query("json_line", "SELECT row_id, instance_id, verified, n_len, md5(body) AS body_md5 FROM traj_rows", "traj_rows")
def _(spark, sf):
    """Every row as a JSON line and back."""
    lines = V.traj_rows(spark, sf).select(X.json_line("row_id", "instance_id", "verified", "n_len", "body").alias("line"))
    back = lines.select(F.from_json("line", "row_id bigint, instance_id string, verified boolean, n_len bigint, body string").alias("r"))
    return back.select("r.row_id", "r.instance_id", "r.verified", "r.n_len", F.md5(F.col("r.body").cast("binary")).alias("body_md5"))


_ELIDED = f"""CASE WHEN length(text) < {C.ELIDE_LENGTH} THEN '<output>' || chr(10) || text || chr(10) || '</output>'
    ELSE '<warning>' || chr(10) || '{C.ELIDE_WARNING.replace("'", "''")}' || chr(10) || '</warning>' || chr(10) || '<output_head>' || chr(10)
      || substr(text, 1, {C.ELIDE_KEEP}) || chr(10) || '</output_head>' || chr(10) || '<elided_chars>' || chr(10)
      || CAST(length(text) - {C.ELIDE_LENGTH} AS VARCHAR) || ' characters elided' || chr(10) || '</elided_chars>' || chr(10)
      || '<output_tail>' || chr(10) || substr(text, length(text) - {C.ELIDE_KEEP} + 1) || chr(10) || '</output_tail>' END"""


@query("str_elide", f"SELECT doc_id, md5({_ELIDED}) AS shown_md5 FROM documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(X.elide(F.col("text")).cast("binary")).alias("shown_md5"))


@query(
    "str_action_count",
    """SELECT doc_id, CAST(doc_id % 3 AS BIGINT) AS n_actions, doc_id % 3 = 1 AS valid FROM documents""",
)
def _(spark, sf):
    """Zero, one or two action blocks after each text."""
    block = F.lit("\n```bash\nls -la\ncat x\n```\n")
    turn = F.concat("text", F.repeat(block, (F.col("doc_id") % 3).cast("int")))
    return V.table(spark, sf, "documents").select(
        "doc_id", X.action_count(turn).cast("bigint").alias("n_actions"), X.is_valid_action(turn).alias("valid")
    )


# --- embedding rows -------------------------------------------------------------------------------


@query(
    "arr_l2_norm",
    f"""SELECT vec_id, round(norm, 5) AS norm, round(norm * gain, 5) AS scaled,
               CASE WHEN norm * gain < {C.COLLAPSED_NORM} THEN 'collapsed' WHEN norm * gain >= {C.HEALTHY_NORM} THEN 'healthy' ELSE 'between' END AS state
        FROM (SELECT vec_id, gain, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM emb)""",
    "emb",
)
def _(spark, sf):
    rows = emb.norm_audit(V.embeddings(spark, sf), "embedding", F.col("gain"))
    return rows.select("vec_id", F.round("norm", 5).alias("norm"), F.round("scaled", 5).alias("scaled"), "state")


@query(
    "agg_centroid",
    """SELECT CAST(pos - 1 AS BIGINT) AS pos, round(avg(embedding[pos]::DOUBLE), 6) AS mean
       FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) GROUP BY 1""",
)
def _(spark, sf):
    return emb.centroid(V.embeddings(spark, sf), "embedding").select(F.col("pos").cast("bigint").alias("pos"), F.round("mean", 6).alias("mean"))


@query(
    "agg_centroid_bf16",
    """SELECT pos, round_even(v / unit, 0) * unit AS value
       FROM (SELECT *, pow(2.0, floor(log2(abs(v))) - 7) AS unit
             FROM (SELECT CAST(pos - 1 AS BIGINT) AS pos, CAST(CAST(avg(embedding[pos]::DOUBLE) AS FLOAT) AS DOUBLE) AS v
                   FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) GROUP BY 1))""",
)
def _(spark, sf):
    """The row that new tokens of a bfloat16 matrix start from."""
    row = emb.centroid_row(V.embeddings(spark, sf), "embedding", bf16=True)
    return row.select(F.posexplode("centroid").alias("pos", "value")).select(F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))


# --- Python surface ---------------------------------------------------------------------------------


@query(
    "udf_row_predicate",
    "SELECT row_id FROM traj_rows WHERE NOT verified AND length(body) >= 100",
    "traj_rows",
)
def _(spark, sf):
    """Row predicates are column expressions."""
    return V.traj_rows(spark, sf).where(~F.col("verified") & (F.char_length("body") >= 100)).select("row_id")


@query("udf_row_map", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_ids FROM documents")
def _(spark, sf):
    """Row maps run in Arrow batches."""
    docs = V.documents(spark, sf).select("doc_id", "text")
    return encode.encode_column(docs, "text", encode.ByteEncoder()).select("doc_id", F.size("input_ids").cast("bigint").alias("n_ids"))


@query(
    "udf_batch_map",
    f"SELECT batch, count(*) AS n_rows FROM {_PLACED} GROUP BY batch",
)
def _(spark, sf):
    """Batch maps run per group of lengths."""
    return _plan(spark, sf).where("piece = 0").groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "udf_sql_functions",
    f"""SELECT doc_id, lang AS repo, md5({_ELIDED}) AS shown_md5 FROM documents""",
)
def _(spark, sf):
    """The text expressions as SQL functions."""
    register_sql_functions(spark)
    docs = V.table(spark, sf, "documents")
    return docs.selectExpr("doc_id", "repo_of(concat(lang, '__', doc_id)) AS repo", "md5(cast(elided(text) AS binary)) AS shown_md5")
