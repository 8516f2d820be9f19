"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorehive.llm.common import staged

# Fixed patterns of the base kinds, in the order of their rank; letters of the first may have either case.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Candidates without a keyword beside them: long runs of base64 or URL-safe characters.
RUN = r"[A-Za-z0-9+/_-]{24,}={0,2}"
KINDS = ("assign", "access", "hex", "live")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running op (a sum, a maximum) of an array of numbers.

    A fold that appends copies what it has; so the array is cut into as many parts as they are long,
    each part is folded, and then the parts' last values are: n numbers cost n times their square
    root, not their square.
    """

    def scan(part: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(part, none, lambda out, x: F.concat(out, F.array(F.when(F.size(out) == 0, x).otherwise(op(F.element_at(out, -1), x)).cast("int"))))

    def whole(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return _let(size, lambda n: _let(F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / n).cast("int") - 1), lambda k: scan(F.slice(v, k * n + 1, n))), joined))

    def joined(parts: Column) -> Column:
        lasts = scan(F.transform(parts, lambda p: F.element_at(p, -1)))
        return _let(lasts, lambda last: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda x: op(x, F.get(last, k - 1)).cast("int"))))))

    return _let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(whole(v)))


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Matches of pattern: array of struct(start, kind, end, value), in code points.

    What lies between matches has known lengths, and so have the matches; their running sum gives
    the positions. value: what the group has.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    # after the last match comes one gap more
    sizes = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), value.alias("value")), lambda x: F.struct((F.length(x["gap"]) + F.coalesce(F.length(x["found"]), F.lit(0))).alias("both"), F.length(x["found"]).alias("found"), x["value"].alias("value")))

    def placed(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda x: x["both"]), lambda a, b: a + b)
        at = lambda e: F.transform(F.slice(all_, 1, F.size(all_) - 1), lambda x, k: F.struct((F.get(e, k) - x["found"]).alias("start"), F.lit(kind).alias("kind"), F.get(e, k).alias("end"), x["value"].alias("value")))
        return _let(ends, at)

    return F.when(text.rlike(pattern), _let(sizes, placed)).otherwise(none)


def apart_from(runs: Column, base: Column) -> Column:
    """runs (apart from each other) that overlap no span of base: in order of their starts, what of base begins
    before a run has ended by then, and what begins after it begins where it has ended."""
    mark = lambda of, is_run: F.transform(of, lambda m: F.struct(m["start"], F.lit(is_run).alias("run"), m["end"], m["kind"], m["value"]))
    most = F.lit(2**31 - 1)

    def kept(all_: Column) -> Column:
        before = running(F.transform(all_, lambda s: F.when(s["run"] == 0, s["end"]).otherwise(0)), F.greatest)
        after = F.reverse(running(F.transform(F.reverse(all_), lambda s: F.when(s["run"] == 0, s["start"]).otherwise(most)), F.least))
        free = lambda b, a: F.filter(all_, lambda s, k: (s["run"] == 1) & (F.get(b, k) <= s["start"]) & (F.get(a, k) >= s["end"]))
        return _let(before, lambda b: _let(after, lambda a: F.transform(free(b, a), lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"]))))

    return F.when((F.size(runs) == 0) | (F.size(base) == 0), runs).otherwise(_let(F.array_sort(F.concat(mark(base, 0), mark(runs, 1))), kept))


def without(text: Column, spans: Column, mark: str, piece: int = 16384) -> Column:
    """text with a mark in place of its spans (start, end), of which overlapping ones are one.

    A place in a text is found by reading on from its beginning; so the text is cut into pieces, and
    what stays is cut out of the pieces that it is in.
    """

    def part(pieces: Column, start: Column, end: Column) -> Column:
        one, last = F.floor(start / piece).cast("int"), F.floor(end / piece).cast("int")
        inside = F.substring(F.get(pieces, one), start % piece + 1, end - start)
        over = F.concat(F.substring(F.get(pieces, one), start % piece + 1, F.lit(piece)), F.array_join(F.slice(pieces, one + 2, F.greatest(last - one - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(pieces, last), F.lit(1), end % piece), F.lit("")))
        return F.when(end <= start, "").when(one == last, inside).otherwise(over)

    def joined(sorted_: Column, ends: Column, pieces: Column, size: Column) -> Column:
        begins = F.transform(sorted_, lambda s, k: F.when((k == 0) | (s["start"] >= F.get(ends, k - 1)), F.concat(part(pieces, F.when(k == 0, 0).otherwise(F.get(ends, k - 1)), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(begins, ""), part(pieces, F.element_at(ends, -1), size))

    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / piece).cast("int")), lambda k: F.substring(text, k * piece + 1, F.lit(piece)))
    ends = lambda s: running(F.transform(s, lambda x: x["end"]), F.greatest)
    return _let(F.array_sort(spans), lambda s: _let(ends(s), lambda e: _let(cut, lambda p: joined(s, e, p, F.length(text)))))


def looks_live(value: Column) -> Column:
    """Small and capital letters, digits, and ten different characters at least."""
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def _varied(value: Column) -> Column:
    """A digit, and eight different characters at least: what a live secret of a base kind has."""
    return value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def _as_text(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def _default_repo(source: Column, lang: Column) -> Column:
    return F.concat_ws("\u0001", F.coalesce(source, F.lit("\u0002")), F.coalesce(lang, F.lit("\u0002")))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: Column | None = None, repo_col: Column | None = None, copied_owners: int = 3, copied_repos: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Secrets in each document, with how widely each candidate is owned.

    Returns a row per row of docs: doc_id, the columns in keep, base and added (arrays of
    struct(start, kind, end); code points, end exclusive), n_live and n_copied (candidates of each
    class in the row), live_spans, and counts: for each candidate of the row its start, kind and end,
    the owners and repositories that have it, and how often it occurs (n), over the corpus.

    Candidates are the base matches and long mixed runs without a keyword. Their SHA-256 hashes
    are counted over the corpus: first per owner and repository, then per owner, then in all, so
    that a hash in a third of all rows is combined before each shuffle. A hash that copied_owners
    owners or copied_repos repositories have, of however few owners, is a widely copied example; any
    other that looks live is owner-specific. Runs that are owner-specific are added as spans of kind
    live; base spans always stay.

    By default the owner is the source, and a repository is a source's part in one language.
    Null or empty text: no spans; very long texts are scanned whole. A null owner or repository counts
    as one of its own. Ties, repeated rows and null ids: each row has its own result. Empty table: no
    rows. Other columns are read only if they are named in keep; names may clash with any used here.
    """
    owner = F.col("source") if owner_col is None else owner_col
    repo = _default_repo(F.col("source"), F.col("lang")) if repo_col is None else repo_col
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda m: F.length(m["value"]) >= 8)
    base = F.concat(assign, matches(text, ACCESS, 1), matches(text, HEX, 2))
    runs = F.filter(matches(text, RUN, 3), lambda m: looks_live(m["value"]))
    row = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep], owner.alias("owner_"), repo.alias("repo_"), base.alias("base"), runs.alias("runs"))
    apart = apart_from(F.col("runs"), F.col("base"))
    hashed = lambda m: F.struct(m["start"], m["kind"], m["end"], F.sha2(m["value"], 256).alias("hash"), ((m["kind"] == 3) | _varied(m["value"])).alias("varied"))
    row = row.withColumn("all", F.transform(F.concat("base", apart), hashed)).drop("base", "runs")
    row = staged(row.withColumn("row_", F.monotonically_increasing_id()), "secret-candidates")

    one = row.select("row_", "owner_", "repo_", F.explode("all").alias("m")).select("row_", "owner_", "repo_", "m.*")
    per_repo = one.groupBy("hash", "owner_", "repo_").agg(F.count("*").alias("n"), F.max("varied").alias("varied"))
    per_owner = per_repo.groupBy("hash", "owner_").agg(F.sum("n").alias("n"), F.count("*").alias("repos"), F.max("varied").alias("varied"))
    owned = per_owner.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.max("varied").alias("varied"))
    copied = (F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos)
    classes = owned.select("hash", (~copied & F.col("varied")).alias("live"), copied.alias("copied"), "owners", "repos", "n")
    found = one.join(classes, "hash").groupBy("row_").agg(
        F.collect_list(F.when((F.col("kind") == 3) & F.col("live"), F.struct("start", "kind", "end"))).alias("added"),
        F.count_if("live").alias("n_live"),
        F.count_if("copied").alias("n_copied"),
        F.collect_list(F.when(F.col("live"), F.struct("start", "kind", "end"))).alias("live_spans"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", "n"))).alias("counts"),
    )
    spans = "array<struct<start:int,kind:int,end:int>>"
    none = F.array().cast(spans)
    base = F.transform(F.filter("all", lambda m: m["kind"] < 3), lambda m: F.struct(m["start"], m["kind"], m["end"]))
    out = row.join(found, "row_", "left")
    return out.select("doc_id", *keep, base.cast(spans).alias("base"), F.coalesce("added", none).alias("added"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("live_spans", none).alias("live_spans"), F.coalesce("counts", F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repos:bigint,n:bigint>>")).alias("counts"))


def secret_digest(scanned: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long")
    return scanned.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_as_text(F.col("base")), 256).alias("base_sha256"), _as_text(F.concat("base", "added")).alias("spans"), "n_live", "n_copied")


def redact_live(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", mark: str = "[SECRET]", copied_owners: int = 3, copied_repos: int = 4) -> DataFrame:
    """docs with live-looking candidates in their texts replaced by a mark, but for those that
    copied_owners owners or copied_repos repositories have: these are examples, and stay. Columns
    stay as they are, but for chars_col, if there is one, which has the new length. Rows without any
    candidate pass by, without a shuffle.

    Null or empty texts and null ids pass; overlapping spans are one mark; very long texts are
    treated whole; repeated rows each stay; a null owner is one of its own. Empty table: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    any_of = text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | text.rlike(RUN)
    some = docs.filter(any_of).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_"))
    scanned = scan_secrets(some, id_col=f"doc_.{id_col}", text_col=f"doc_.{text_col}", owner_col=F.col(f"doc_.{source_col}"), repo_col=_default_repo(F.col(f"doc_.{source_col}"), F.col(f"doc_.{lang_col}")), copied_owners=copied_owners, copied_repos=copied_repos, keep=("doc_",))
    whole = F.col(f"doc_.{text_col}")

    new = F.when(F.size("live_spans") == 0, whole).otherwise(without(whole, F.col("live_spans"), mark))
    scanned = scanned.withColumn("new_", new)
    doc = F.col("doc_").withField(text_col, F.col("new_"))
    if chars_col in docs.columns:
        doc = doc.withField(chars_col, F.when(F.size("live_spans") == 0, F.col(f"doc_.{chars_col}")).otherwise(F.length("new_")).cast(docs.schema[chars_col].dataType))
    return docs.filter(~any_of).unionByName(scanned.select(doc.alias("doc_")).select("doc_.*"))
