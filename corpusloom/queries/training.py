"""Training rows: pairs, tokens, labels, packing and samples."""

from pyspark.sql import functions as F

from corpusloom.functions import tokens as T
from corpusloom.functions.text import words
from corpusloom.operators import batches, preferences
from corpusloom.queries import query, sqltext as S
from corpusloom.queries.conversations import M, _QA, qa_pairs
from corpusloom.session import saved, table

_KEY = "session_id || ':' || turn"
# the wanted answer is the real one; the unwanted one lacks its first 40 characters
_PAIRS = f"""pairs AS (SELECT {_KEY} AS id, question || ' ' || answer AS chosen, question || ' ' || substring(answer, 41) AS rejected FROM qa)"""


def pairs(spark, d):
    """Paired rows whose prompt is still in both answers."""
    qa = qa_pairs(spark, d)
    return qa.select(
        F.concat_ws(":", "session_id", "turn").alias("id"),
        F.concat_ws(" ", "question", "answer").alias("chosen"),
        F.concat("question", F.lit(" "), F.substr("answer", F.lit(41), F.length("answer"))).alias("rejected"),
    )


_SPLIT = """lcp AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(chosen), length(rejected)) + 1),
        lambda i: left(chosen, i) = left(rejected, i))), 0) AS same FROM pairs),
    cutat AS (SELECT *, CASE WHEN same = least(length(chosen), length(rejected)) THEN greatest(same - 1, 0)
        WHEN same > 0 AND substring(chosen, same, 1) = ' ' THEN same - 1 ELSE same END AS n FROM lcp),
    split AS (SELECT id, substring(chosen, 1, n) AS prompt, substring(chosen, n + 1) AS chosen, substring(rejected, n + 1) AS rejected FROM cutat)"""
_PREF = f"{M}, {_QA}, {_PAIRS}, {_SPLIT}"


def split_pairs(spark, d):
    return preferences.extract_prompt(pairs(spark, d))


@query("extracted_prompts", f"WITH {_PREF} SELECT id, prompt, chosen, rejected FROM split")
def extracted_prompts(spark, d):
    return split_pairs(spark, d)


@query(
    "unpaired_rows",
    f"""WITH {_PREF} SELECT id, prompt, chosen AS completion, true AS label FROM split
    UNION ALL SELECT id, prompt, rejected, false FROM split""",
)
def unpaired_rows(spark, d):
    return preferences.unpair(split_pairs(spark, d))


def _words(e: str) -> str:
    return f"list_filter(string_split_regex({e}, '[{S.SPACE}]+'), lambda x: x <> '')"


_TOK = f"{_PREF}, tok AS (SELECT id, {_words('prompt')} AS p, {_words('chosen')} AS c, {_words('rejected')} AS r FROM split)"


def token_pairs(spark, d):
    return split_pairs(spark, d).select("id", *[words(c).alias(c) for c in ("prompt", "chosen", "rejected")])


def _joined(df, *names):
    return df.select(*[F.array_join(c, " ").alias(c) if c in names else F.col(c) for c in df.columns])


_SIDES = ("prompt", "chosen", "rejected")


def _j(e: str) -> str:
    return f"array_to_string({e}, ' ')"


@query("fitting_pairs", f"WITH {_TOK} SELECT id FROM tok WHERE len(c) <= 150 AND len(r) <= 150")
def fitting_pairs(spark, d):
    return preferences.fitting_pairs(token_pairs(spark, d), 150).select("id")


@query(
    "word_tokens",
    f"""WITH t AS (SELECT doc_id, {_words('text')} AS w FROM documents)
    SELECT doc_id, {_j("CASE WHEN w[1] = 'the' THEN w[1:256] ELSE list_concat(['the'], w)[1:256] END")} AS input_ids FROM t""",
)
def word_tokens(spark, d):
    """Word tokens, cut to 256, with a begin token that is not doubled."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return T.tokenize(docs, "text", limit=256, begin="the").select("doc_id", F.array_join("input_ids", " ").alias("input_ids"))




def _texts(row: dict) -> list[str]:
    """The whole turn, and the answer once more where the question is short; none for turn 2."""
    if row["turn"] == 2:
        return []
    whole = f"<s> {row['question']} {row['answer']}"
    return [whole, row["answer"]] if len(row["question"]) < 400 else [whole]


@query(
    "formatted_tokens",
    f"""WITH {M}, {_QA}, f AS (SELECT session_id, turn, 0 AS place, '<s> ' || question || ' ' || answer AS text FROM qa WHERE turn <> 2
        UNION ALL SELECT session_id, turn, 1, answer FROM qa WHERE turn <> 2 AND length(question) < 400),
    t AS (SELECT session_id, turn, place, {_words('text')}[1:64] AS w FROM f)
    SELECT session_id, turn, place, {_j('w')} AS input_ids, len(w) AS ones FROM t""",
)
def formatted_tokens(spark, d):
    """Several texts a row. The first brings its begin token, so none is added to any."""
    rows = T.formatted(qa_pairs(spark, d), _texts, ["session_id", "turn"])
    written = T.begin_is_written(rows, "text", "<s>", ["session_id", "turn", "place"])
    out = T.tokenize(rows, "text", limit=64, begin="<s>", written=written, mask="attention_mask")
    ones = F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x)
    return out.select("session_id", "turn", "place", F.array_join("input_ids", " ").alias("input_ids"), ones.cast("long").alias("ones"))


@query(
    "extracted_prompt_messages",
    f"""WITH {M}, {_QA} SELECT session_id, turn, 'user: ' || question AS prompt,
    'assistant: ' || answer AS chosen, 'assistant: ' || substring(answer, 41) AS rejected FROM qa""",
)
def extracted_prompt_messages(spark, d):
    """Conversations that share their first message."""

    def said(answer):
        message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
        return F.array(message("user", F.col("question")), message("assistant", answer))

    short = F.substr("answer", F.lit(41), F.length("answer"))
    rows = qa_pairs(spark, d).select("session_id", "turn", said(F.col("answer")).alias("chosen"), said(short).alias("rejected"))
    line = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias(c)
    return preferences.extract_prompt(rows).select("session_id", "turn", line("prompt"), line("chosen"), line("rejected"))


def _last(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) > {n} THEN list_slice({x}, len({x}) - {n} + 1, len({x})) ELSE {x} END"


@query(
    "pair_tokens",
    f"""WITH {_TOK}, e AS (SELECT id, list_concat(['<s>'], list_append(p, '</s>')) AS p, list_append(c, '</s>') AS c, list_append(r, '</s>') AS r FROM tok)
    SELECT id, {_j(_last('p', 16))} AS prompt, {_j('c[1:64]')} AS chosen, {_j('r[1:64]')} AS rejected FROM e""",
)
def pair_tokens(spark, d):
    rows = preferences.pair_tokens(token_pairs(spark, d), "</s>", "<s>", 16, 64, special=True)
    return _joined(rows, *_SIDES)


@query(
    "agreeing_prompts",
    f"""WITH {_PREF}, a AS (SELECT id, {_words('prompt')} AS p, {_words('substring(chosen || prompt, 1, length(prompt))')} AS q FROM split)
    SELECT id, len(list_filter(list_zip(p, q), lambda z: z[1] IS NOT NULL AND z[2] IS NOT NULL AND z[1] <> z[2])) <= 1
        AND abs(len(p) - len(q)) <= 1 AS agree FROM a""",
)
def agreeing_prompts(spark, d):
    mixed = F.substr(F.concat("chosen", "prompt"), F.lit(1), F.length("prompt"))
    rows = split_pairs(spark, d).select("id", words("prompt").alias("p"), words(mixed).alias("q"))
    good, aside = preferences.checked_prompts(rows, "p", "q")
    return good.select("id", F.lit(True).alias("agree")).unionByName(aside.select("id", F.lit(False).alias("agree")))


_MARKED = f"""{_TOK}, mk AS (SELECT id, CASE WHEN p[1] = 'the' THEN p ELSE list_concat(['the'], p) END AS p,
    CASE WHEN c[-1] = '.' THEN c ELSE list_append(c, '.') END AS c, CASE WHEN r[-1] = '.' THEN r ELSE list_append(r, '.') END AS r FROM tok)"""


@query("marked_pairs", f"WITH {_MARKED} SELECT id, {_j('p')} AS prompt, {_j('c')} AS chosen, {_j('r')} AS rejected FROM mk")
def marked_pairs(spark, d):
    return _joined(preferences.marked_pair(token_pairs(spark, d), "the", "."), *_SIDES)


def _truncated_sql(mode: str) -> str:
    kept = "p[1:20]" if mode == "keep_start" else _last("p", 20)
    return f"""{_TOK}, t1 AS (SELECT *, greatest(len(c), len(r)) AS m FROM tok),
    t2 AS (SELECT id, CASE WHEN len(p) + m > 100 THEN {kept} ELSE p END AS p, c, r, m FROM t1),
    t3 AS (SELECT id, p, CASE WHEN len(p) + m > 100 THEN c[1:80] ELSE c END AS c, CASE WHEN len(p) + m > 100 THEN r[1:80] ELSE r END AS r FROM t2)"""


for _mode, _name in (("keep_end", "truncated_pairs"), ("keep_start", "truncated_pairs_from_start")):

    def _run(spark, d, mode=_mode):
        return _joined(preferences.truncated_pair(token_pairs(spark, d), 100, 20, mode), *_SIDES)

    query(_name, f"WITH {_truncated_sql(_mode)} SELECT id, {_j('p')} AS prompt, {_j('c')} AS chosen, {_j('r')} AS rejected FROM t3")(_run)


@query(
    "pair_labels",
    f"""WITH {_truncated_sql('keep_end')} SELECT id, {_j("list_concat(list_transform(p, lambda x: '-100'), c)")} AS chosen_labels,
    {_j("list_concat(list_transform(p, lambda x: '-100'), r)")} AS rejected_labels, {_j('list_concat(p, c)')} AS chosen_input_ids,
    {_j('list_concat(p, r)')} AS rejected_input_ids FROM t3""",
)
def pair_labels(spark, d):
    rows = preferences.truncated_pair(token_pairs(spark, d), 100, 20)
    out = preferences.pair_labels(rows, "-100").drop(*_SIDES)
    return _joined(out, "chosen_labels", "rejected_labels", "chosen_input_ids", "rejected_input_ids")


@query(
    "truncated_tokens",
    f"""WITH t AS (SELECT doc_id, {_words('text')} AS w FROM documents)
    SELECT doc_id, {_j('w[1:32]')} AS keep_start, {_j(_last('w', 32))} AS keep_end FROM t""",
)
def truncated_tokens(spark, d):
    w = F.col("w")
    docs = table(spark, d, "documents", spread=True).select("doc_id", words("text").alias("w"))
    return docs.select(
        "doc_id",
        F.array_join(T.truncate(w, 32), " ").alias("keep_start"),
        F.array_join(T.truncate(w, 32, "keep_end"), " ").alias("keep_end"),
    )


# an answer's lines are its steps; a step is right when its length is even
_STEPS = f"""st AS (SELECT {_KEY} AS id, {_words('question')} AS p, string_split(answer, chr(10)) AS ls FROM qa),
    sl AS (SELECT id, p, list_transform(ls, lambda l: list_append({_words('l')}, '<sep>')) AS steps,
        list_transform(ls, lambda l: CASE WHEN length(l) % 2 = 0 THEN '1' ELSE '0' END) AS labs FROM st),
    sm AS (SELECT id, {_last("list_concat(['<s>'], p)", 12)} AS p, flatten(steps)[1:90] AS ans,
        flatten(list_transform(steps, lambda s, i: list_append(list_transform(s[1:len(s) - 1], lambda x: '-100'),
            CASE WHEN {{last}} THEN labs[i] ELSE '-100' END)))[1:90] AS al FROM sl)
    SELECT id, {_j('list_concat(p, ans)[1:100]')} AS input_ids, {_j("list_concat(list_transform(p, lambda x: '-100'), al)[1:100]")} AS labels FROM sm"""


def _step_rows(spark, d, last_only):
    lines = F.split("answer", "\n")
    rows = qa_pairs(spark, d).select(
        F.concat_ws(":", "session_id", "turn").alias("id"),
        words("question").alias("prompt"),
        F.transform(lines, lambda x: words(x)).alias("steps"),
        F.transform(lines, lambda x: F.length(x) % 2 == 0).alias("labels"),
    )
    out = T.step_rows(
        F.col("prompt"), F.col("steps"), F.col("labels"), F.array(F.lit("<sep>")), "<s>", 12, 90, 100, last_only
    )
    rows = rows.select("id", out.alias("o")).select("id", "o.*")
    return _joined(rows.withColumn("labels", F.col("labels").cast("array<string>")), "input_ids", "labels")


@query("step_rows", f"WITH {M}, {_QA}, {_STEPS.replace('{last}', 'true')}")
def step_rows(spark, d):
    return _step_rows(spark, d, False)


@query("last_step_rows", f"WITH {M}, {_QA}, {_STEPS.replace('{last}', 'i = len(labs)')}")
def last_step_rows(spark, d):
    return _step_rows(spark, d, True)


def _token_rows(spark, d):
    """Documents as tokens, made once: packing reads them several times."""
    docs = table(spark, d, "documents", spread=True)
    return saved(docs.select("doc_id", words("text").alias("w")))


@query(
    "packed_wrapped",
    f"""WITH t AS (SELECT doc_id, {_words('text')} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
    n AS (SELECT x, row_number() OVER (ORDER BY doc_id, i) - 1 AS k FROM u)
    SELECT k // 512 AS sequence, string_agg(x, ' ' ORDER BY k) AS input_ids FROM n GROUP BY 1""",
)
def packed_wrapped(spark, d):
    return _joined(batches.packed_wrapped(_token_rows(spark, d), ["doc_id"], "w", 512), "input_ids")


_BFD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(0, (len(w) + 1023) // 1024)) AS p FROM d),
    t AS (SELECT doc_id, p, w[p * 1024 + 1:(p + 1) * 1024] AS w, row_number() OVER (ORDER BY doc_id, p) AS rn FROM c),
    items AS (SELECT doc_id, w, len(w) AS n, (rn - 1) // 1000 AS batch, row_number() OVER (PARTITION BY (rn - 1) // 1000 ORDER BY len(w) DESC, doc_id, p) AS k FROM t),
    fit AS (
      SELECT DISTINCT batch, 0::BIGINT AS k, []::BIGINT[] AS room, 0::BIGINT AS bin FROM items
      UNION ALL
      SELECT batch, k, CASE WHEN bin > len(room) THEN list_append(room, 1024 - n) ELSE list_concat(list_append(room[1:bin - 1], room[bin] - n), room[bin + 1:]) END, bin
      FROM (SELECT f.batch, i.k, room, i.n, coalesce(list_position(room, list_min(list_filter(room, lambda r: r >= i.n))), len(room) + 1)::BIGINT AS bin
            FROM fit f JOIN items i ON i.batch = f.batch AND i.k = f.k + 1)
    )
    SELECT i.batch, f.bin - 1 AS bin, string_agg(array_to_string(w, ' '), ' ' ORDER BY i.k) AS input_ids,
        string_agg(i.n::VARCHAR, ',' ORDER BY i.k) AS lengths FROM fit f JOIN items i ON i.batch = f.batch AND i.k = f.k GROUP BY ALL"""


@query("packed_best_fit", _BFD)
def packed_best_fit(spark, d):
    out = batches.packed_best_fit(_token_rows(spark, d), "doc_id", "w", 1024)
    return _joined(out.withColumn("lengths", F.array_join("lengths", ",")), "input_ids")


_N = f"qn AS (SELECT *, (row_number() OVER (ORDER BY session_id, turn) - 1) // 4 AS batch FROM qa)"


@query(
    "mismatched_pairs",
    f"""WITH {M}, {_QA}, {_N} SELECT session_id, turn, batch, question, coalesce(lag(answer) OVER w, last_value(answer) OVER
    (PARTITION BY batch ORDER BY session_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other FROM qn WINDOW w AS (PARTITION BY batch ORDER BY session_id, turn)""",
)
def mismatched_pairs(spark, d):
    return batches.mismatched(saved(qa_pairs(spark, d)), ["session_id", "turn"], "answer", "other", 4).drop("answer")


@query(
    "mirrored_pairs",
    f"""WITH {M}, {_QA}, {_N}, r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY session_id, turn) AS i, count(*) OVER (PARTITION BY batch) AS c FROM qn)
    SELECT a.session_id, a.turn, a.batch, a.question, b.answer AS other FROM r a JOIN r b ON a.batch = b.batch AND b.i = a.c - a.i + 1""",
)
def mirrored_pairs(spark, d):
    return batches.mismatched(saved(qa_pairs(spark, d)), ["session_id", "turn"], "answer", "other", 4, "reverse").drop("answer")


@query(
    "zipped_columns",
    f"SELECT doc_id, n_chars, len({_words('text')}) AS n_words FROM documents",
)
def zipped_columns(spark, d):
    docs = table(spark, d, "documents")
    return batches.zip_columns(docs.select("doc_id", "n_chars"), docs.select("doc_id", F.size(words("text")).alias("n_words")), "doc_id")


@query("sampled_rows", "SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 64")
def sampled_rows(spark, d):
    return batches.sample_rows(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 64, 7)


@query(
    "sampled_with_repeats",
    f"""WITH h AS (SELECT doc_id, quality, md5('3:' || doc_id) AS h, {S.md5_number("'3:' || doc_id", 15)} % 64 AS bucket FROM labels),
    n AS (SELECT doc_id, quality, row_number() OVER (ORDER BY bucket, h, doc_id) AS place, count(*) OVER () AS rows FROM h),
    dr AS (SELECT unnest(range(1, least(512, (SELECT count(*) FROM labels)) + 1)) AS draw)
    SELECT doc_id, quality, draw FROM dr JOIN n ON place = {S.md5_number("'3:' || draw", 15)} % rows + 1""",
)
def sampled_with_repeats(spark, d):
    return batches.sample_with_repeats(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", 512, 3, 64)


@query("repeated_rows", "SELECT item_id, unnest(range(0, 4)) AS copy, md5('1:' || item_id) AS shuffle_key FROM benchmark")
def repeated_rows(spark, d):
    return batches.repeated(table(spark, d, "benchmark").select("item_id"), "item_id", 4, 1)
