"""Column builders for text cleaning and token work (all JVM-side expressions).

The cleaning rules reproduce Python ``str`` / ``re`` semantics with Java regex:
``(?U)`` makes ``\\s``, ``\\w`` and ``\\b`` Unicode-aware, and Python's ``str.split()``
also splits on the ASCII separators U+001C..U+001F, so they are added to every
whitespace class.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's cleaning rules) -----------------------
# Python string.punctuation, the 32 ASCII punctuation marks, in their natural order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Whitespace as seen by Python's str.split(): Unicode White_Space plus U+001C..U+001F.
_WS = r"\s\x1c-\x1f"
WS_RUN = r"(?U)[" + _WS + r"]+"
NON_WS = r"[^" + _WS + r"]"
URL_PATTERN = r"(?U)http" + NON_WS + r"+|www" + NON_WS + r"+|https" + NON_WS + r"+"
EMAIL_PATTERN = r"(?U)" + NON_WS + r"+@" + NON_WS + r"+"
AMPM_PATTERN = r"(?U)\b(am|pm|AM|PM)\b"
DIGITS_PATTERN = r"\p{Nd}+"
NOT_ASCII_LETTER_OR_WS = r"(?U)[^a-zA-Z" + _WS + r"]"
DIGITS_OR_PUNCTUATION = "[" + "".join("\\" + c for c in PUNCTUATION) + r"0123456789\p{Nd}]+"
# What every lower-case match of AMPM_PATTERN is, tried without Unicode word boundaries.
AMPM_LIKELY = r"[ap]m(?![a-z])(?<![a-z]..)"
# ---------------------------------------------------------------------------------------

def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_whitespace(c: Column | str) -> Column:
    """``' '.join(s.split())``: runs of whitespace → one space, ends trimmed."""
    return F.trim(F.regexp_replace(_c(c), WS_RUN, " "))


def is_blank(c: Column | str) -> Column:
    """Whether a text has nothing but white space; the search ends at the first other character."""
    return ~_c(c).rlike(r"(?U)" + NON_WS)


def clean_basic(c: Column | str) -> Column:
    """null or '' → ''; CR/LF → space; whitespace collapsed and trimmed."""
    c = _c(c)
    return F.when(c.isNull(), F.lit("")).otherwise(collapse_whitespace(c))


def lowercase(c: Column | str) -> Column:
    return F.lower(_c(c))


def strip_urls(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), URL_PATTERN, "")


def strip_emails(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), EMAIL_PATTERN, "")


def strip_ampm(c: Column | str) -> Column:
    """Whole words am/pm; ``10pm`` keeps ``pm`` because digits are removed later."""
    return F.regexp_replace(_c(c), AMPM_PATTERN, "")


def strip_digits(c: Column | str) -> Column:
    """Unicode decimal digits (category Nd), as Python's ``\\d``."""
    return F.regexp_replace(_c(c), DIGITS_PATTERN, "")


def strip_punctuation(c: Column | str) -> Column:
    """The 32 ASCII punctuation marks; typographic quotes and dashes stay."""
    return F.translate(_c(c), PUNCTUATION, "")


def clean_advanced(c: Column | str) -> Column:
    """lower → URLs → e-mails → am/pm → digits → punctuation → whitespace.

    Not idempotent (``a.m. h.ttp://x`` → ``am httpx`` → ''), so apply it once.
    """
    c = _c(c)
    out = lowercase(c)
    out = strip_urls(out)
    out = strip_emails(out)
    out = strip_ampm(out)
    out = strip_digits(out)
    out = strip_punctuation(out)
    out = collapse_whitespace(out)
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(out)


def clean_advanced_df(df: DataFrame, in_col: str, out_col: str, collapsed: bool = False) -> DataFrame:
    """``clean_advanced`` as staged projections with literal guards (same result).

    Each regex runs only on rows containing the literal it needs (``http``/``www``, ``@``,
    ``am``/``pm`` after lower-casing); on other rows it could not match. Digits and
    punctuation go in one pass. Each stage is its own projection over a column reference, so
    the guard does not duplicate the upstream expression and Catalyst keeps the stages apart
    (the column is referenced three times). ``collapsed`` says that ``in_col`` is the output
    of ``collapse_whitespace`` or ``clean_basic``: its gaps are then put right by literal
    replacements, and by the regex only where a gap was wider than four spaces.
    """
    stages = [f"_ca{i}" for i in range(1, 6)]
    s1, s2, s3, s4, s5 = stages
    x = F.col(in_col)
    out = df.withColumn(s1, lowercase(x))
    c1 = F.col(s1)
    out = out.withColumn(s2, F.when(c1.contains("http") | c1.contains("www"), strip_urls(c1)).otherwise(c1))
    c2 = F.col(s2)
    out = out.withColumn(s3, F.when(c2.contains("@"), strip_emails(c2)).otherwise(c2))
    c3 = F.col(s3)
    likely = (c3.contains("am") | c3.contains("pm")) & c3.rlike(AMPM_LIKELY)
    out = out.withColumn(s4, F.regexp_replace(F.when(likely, strip_ampm(c3)).otherwise(c3), DIGITS_OR_PUNCTUATION, ""))
    rest = F.col(s4)
    if collapsed:
        halved = F.replace(F.replace(rest, F.lit("  "), F.lit(" ")), F.lit("  "), F.lit(" "))
        out = out.withColumn(s5, halved)
        rest = F.trim(F.when(F.col(s5).contains("  "), F.regexp_replace(s5, " +", " ")).otherwise(F.col(s5)))
    else:
        rest = collapse_whitespace(rest)
    out = out.withColumn(out_col, F.when(x.isNull() | (x == ""), F.lit("")).otherwise(rest))
    return out.drop(*stages)


def newline_to_space(c: Column | str) -> Column:
    return F.replace(_c(c), F.lit("\n"), F.lit(" "))


def letters_only(c: Column | str) -> Column:
    """Drop am/pm words, then everything except ASCII letters and whitespace."""
    return F.regexp_replace(strip_ampm(c), NOT_ASCII_LETTER_OR_WS, "")


def tokens(c: Column | str) -> Column:
    """Whitespace tokens as Python ``str.split()``: empty array for blank text.

    The input is referenced once, so an expensive argument is evaluated once per row.
    """
    return F.filter(F.split(collapse_whitespace(_c(c)), " "), lambda x: x != "")


def split_clean(c: Column | str) -> Column:
    """Tokens of text already normalised by ``collapse_whitespace`` (``clean_basic`` /
    ``clean_advanced`` output: single spaces, trimmed) — a plain split, no regex.

    Equal to ``tokens`` on such text except that '' gives ``['']``; callers drop the empty
    token (after ``explode`` that filter stays inside whole-stage codegen).
    """
    return F.split(_c(c), " ")


def word_count(c: Column | str) -> Column:
    return F.size(tokens(c)).cast("bigint")


def text_length(c: Column | str, null_as: str | None = "nan") -> Column:
    """Characters of the text; a null text counts as the string ``nan`` unless disabled."""
    c = _c(c)
    return F.length(F.coalesce(c, F.lit(null_as)) if null_as is not None else c).cast("bigint")


def _in_list(x: Column, words: Iterable[str]) -> Column:
    words = list(dict.fromkeys(words))
    if not words:
        return F.lit(False)
    return x.isin(words)  # becomes InSet (hash lookup) beyond a few entries


def count_in(token_array: Column, words: Iterable[str]) -> Column:
    """Number of tokens that are in ``words`` (whole-token match, never ``\\b`` regex).

    '' is never a word (no whitespace token is empty), so ``split_clean`` arrays may be passed.
    """
    words = [w for w in words if w != ""]
    return F.size(F.filter(token_array, lambda x: _in_list(x, words)))


def count_in_clean(c: Column | str, words: Iterable[str]) -> Column:
    """``count_in`` over the tokens of ``split_clean`` text, without making them: only texts that hold a word are searched."""
    c = _c(c)
    words = [w for w in dict.fromkeys(words) if w != "" and " " not in w]
    if not words:
        return F.when(c.isNotNull(), F.lit(0))
    there = reduce(or_, [c.contains(w) for w in words])
    found = F.regexp_count(c, F.lit("(?<![^ ])(?:" + "|".join(re.escape(w) for w in words) + ")(?![^ ])"))
    return F.when(there, found).when(c.isNotNull(), F.lit(0))


def remove_stopwords(c: Column | str, stopwords: Iterable[str] | None = None) -> Column:
    """Drop stop-words from the whitespace tokens, keep duplicates and order, join by space."""
    if stopwords is None:
        from reviewlens.functions.stopwords import ENGLISH

        stopwords = ENGLISH
    stop = list(stopwords)
    return F.array_join(F.filter(tokens(c), lambda x: ~_in_list(x, stop)), " ")


def map_literal(mapping: Mapping[str, str]) -> Column:
    items = sorted(mapping.items())
    if not items:
        return F.create_map().cast("map<string,string>")
    return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in items]),
                             F.array(*[F.lit(v) for _, v in items]))


def lookup_tokens(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace each whitespace token by ``mapping[token]`` when present; join by space.

    The mapping is a literal of the plan, given by the caller; a table of forms goes through
    ``lookup_tokens_df``.
    """
    m = map_literal(mapping)
    return F.array_join(
        F.transform(tokens(c), lambda t: F.coalesce(F.try_element_at(m, t), t)), " ")


def lookup_tokens_df(df: DataFrame, col: str, table: DataFrame, form: str = "form",
                     replacement: str = "replacement", out: str | None = None) -> DataFrame:
    """Token lookup against a ``(form, replacement)`` table of any size; one plan at every size.

    Rows get a generated id and are written once to the shared scratch folder (the id must
    not change between the two reads). Tokens are exploded with their position, joined to the
    table, and put together again per row in position order; the join is the optimizer's
    choice (a broadcast of a small table, else a shuffle whose hot tokens AQE splits). Rows
    stay apart whatever their other columns are. A form listed twice with one replacement
    counts once; with two different ones the query fails, naming it. Null forms and forms
    with a null replacement change nothing. A null text stays null, a blank one is ''.
    """
    from reviewlens.session import shared_dir

    out = out or col
    rid, pos, tok, rep = "_lk_id", "_lk_pos", "_lk_tok", "_lk_rep"
    path = f"{shared_dir(df.sparkSession, 'lookup-rows')}/rows.parquet"
    df.withColumn(rid, F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    forms = (table.select(F.col(form).alias("_lk_form"), F.col(replacement).alias(rep)).dropna()
             .groupBy("_lk_form").agg(F.min(rep).alias("_lk_lo"), F.max(rep).alias("_lk_hi")))
    clash = F.raise_error(F.concat(F.lit("conflicting replacements of the form "), F.col("_lk_form")))
    forms = forms.select("_lk_form", F.when(F.col("_lk_lo") == F.col("_lk_hi"), F.col("_lk_lo"))
                         .otherwise(clash.cast("string")).alias(rep))
    exploded = rows.select(rid, F.posexplode(tokens(col)).alias(pos, tok))
    joined = exploded.join(forms, F.col(tok) == F.col("_lk_form"), "left").select(rid, pos, F.coalesce(rep, tok).alias(tok))
    regrouped = joined.groupBy(F.col(rid).alias("_lk_key")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, tok))), lambda s: s[tok]), " ").alias("_lk_out"))
    text = F.coalesce("_lk_out", F.when(F.col(col).isNotNull(), F.lit("")))
    res = rows.join(regrouped, F.col(rid) == F.col("_lk_key"), "left").withColumn(out, text)
    return res.select(*[F.col(f"`{c}`") for c in [*df.columns, *([] if out in df.columns else [out])]])


#: Forms that are sent to the tasks at most, in bytes; more of them meet the tokens in a join.
LOOKUP_BYTES = 64 << 20


#: Tokens that a task looks up at a time, about (one text, if it has more).
LOOKUP_TOKENS = 1 << 20


def _token_pieces(batches, at: int, limit: int):
    """Slices of batches with at most ``limit`` tokens in the lists of column ``at``, or of one row."""
    import numpy as np

    for b in batches:
        ends, a = b.column(at).offsets.to_numpy(), 0
        while a < b.num_rows:
            z = max(int(np.searchsorted(ends, ends[a] + limit, "right")) - 1, a + 1)
            yield b.slice(a, z - a)
            a = z


def _lookup_in_rows(table, at: int, limit: int = LOOKUP_TOKENS):
    """Tokens (a list in column ``at``) replaced by their value; ``table`` is a broadcast Arrow stream of forms and values."""
    def in_task(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        keys, new = pa.ipc.open_stream(pa.py_buffer(table.value)).read_all().combine_chunks().columns
        keys, new = (c.combine_chunks() for c in (keys, new))
        for b in _token_pieces(batches, at, limit):
            lists = b.column(at)
            flat = lists.flatten()
            found = new.take(pc.index_in(flat, value_set=keys))
            sizes = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0))])
            done = pa.ListArray.from_arrays(sizes, pc.coalesce(found, flat))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], done, *b.columns[at + 1:]], schema=pa.schema(
                [*list(b.schema)[:at], pa.field(b.schema.names[at], done.type), *list(b.schema)[at + 1:]]))
    return in_task


def _arrow_stream(pairs) -> bytes:
    import pyarrow as pa

    table = pa.table({"form": pa.array([r[0] for r in pairs], pa.string()), "value": pa.array([r[1] for r in pairs], pa.string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def lookup_tokens_table(df: DataFrame, col: str, table: DataFrame, form: str = "form", replacement: str = "replacement",
                        out: str | None = None, send_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """``lookup_tokens_df`` without moving rows: only the table's forms that occur in the texts go to the tasks.

    The distinct tokens (combined in each task before they are shuffled) meet the table first;
    what is found, as a rule a small part of the table, is measured and sent to the tasks, where
    each row's tokens are looked up. If it is larger than ``send_bytes``, ``lookup_tokens_df``
    does the work. Same result and same rules in both cases.
    """
    from reviewlens.session import staged

    out = out or col
    rows = df.select(F.explode(F.array_distinct(tokens(col))).alias("_token")).distinct()
    known = (table.select(F.col(form).alias("_form"), F.col(replacement).alias("_new")).dropna()
             .groupBy("_form").agg(F.min("_new").alias("lo"), F.max("_new").alias("hi")))
    clash = F.raise_error(F.concat(F.lit("conflicting replacements of the form "), F.col("_form"))).cast("string")
    known = known.select("_form", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(clash).alias("_new"))
    found = staged(rows.join(known, F.col("_token") == F.col("_form")).select("_form", "_new"), "lookup-found")
    size = found.agg(F.sum(F.octet_length("_form") + F.octet_length("_new") + 16)).first()[0] or 0
    if size > send_bytes:
        return lookup_tokens_df(df, col, table, form, replacement, out)
    sent = df.sparkSession.sparkContext.broadcast(_arrow_stream(found.orderBy("_form").collect()))  # at most ``send_bytes``
    names = [f"_c{i}" for i in range(len(df.columns))]
    wide = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)],
                     F.coalesce(tokens(F.col(f"`{col}`")), F.array().cast("array<string>")).alias("_tokens"))
    done = wide.mapInArrow(_lookup_in_rows(sent, len(names)), wide.schema)
    source = F.col(names[df.columns.index(col)])
    text = F.when(source.isNotNull(), F.array_join("_tokens", " "))
    return done.select(*[(text if c == out else F.col(n)).alias(c) for c, n in zip(df.columns, names)],
                       *([] if out in df.columns else [text.alias(out)]))


def bigrams(token_array: Column | str) -> Column:
    """Adjacent token pairs joined by a space; empty for fewer than two tokens.

    Pass a column (a materialised token array): the array is read twice, by two slices
    zipped together, which is linear in the number of tokens. ``sequence`` + ``element_at``
    would count down on one-token input and re-evaluate an unmaterialised argument per pair.
    """
    a = _c(token_array)
    pairs = F.arrays_zip(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
                         F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))))
    return F.transform(F.filter(pairs, lambda p: p["1"].isNotNull()),
                       lambda p: F.concat_ws(" ", p["0"], p["1"]))


def truncate_tokens(c: Column | str, max_tokens: int = 512) -> Column:
    """At most ``max_tokens`` whitespace tokens (the model input cap)."""
    return F.array_join(F.slice(tokens(c), 1, max_tokens), " ")


def title_case(c: Column | str) -> Column:
    """``negative`` → ``Negative``; ``total_rows`` → ``Total Rows``."""
    return F.initcap(F.replace(_c(c), F.lit("_"), F.lit(" ")))
