"""Reports on the tracking tables: counts, lists, duplicates, orphans and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .references import OUTER_SPACE

STATES = {"indexed": (1,), "pending": (0, 3), "failed": (2,), "all": (0, 1, 2, 3)}


def newest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the greatest `version` of each key; of equal ones the greatest row, so any order gives the same."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(F.col(version), *[F.col(c).cast("string") for c in rest])
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return best.select(key, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def active(files: DataFrame) -> DataFrame:
    return files.where(F.col("status") == "active")


def status_counts(files: DataFrame, by: str | None = None) -> DataFrame:
    """`total`, `indexed`, `pending`, `failed` of the active files, in all (one row, zeros for none) or by a column."""
    aggs = [F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("indexed").isin(*STATES[s])).alias(s) for s in ("indexed", "pending", "failed")]]
    return (active(files).groupBy(by) if by else active(files)).agg(*aggs)


def file_type_stats(files: DataFrame) -> DataFrame:
    """Active files by lower-case extension; here an extracted file counts as indexed."""
    ext = F.lower(F.coalesce("file_ext", F.lit("")))
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("indexed").isin(1, 3)).alias("indexed"), F.count_if(F.col("indexed") == 0).alias("pending"), F.count_if(F.col("indexed") == 2).alias("failed")]
    return active(files).groupBy(ext.alias("ext")).agg(*aggs)


def browse_types(files: DataFrame) -> DataFrame:
    """The supported extensions that active files have."""
    ext = F.lower("file_ext")
    return active(files).where(S.is_supported(ext)).select(ext.alias("ext")).distinct()


def browse(files: DataFrame, state: str = "all", ext: str | None = None, text: str | None = None, sort: str = "path", ascending: bool = True, page: int = 1, size: int = 50) -> DataFrame:
    """One page of active files by state, extension and part of the path (any case), in a total order; sizes from 1 to 1000."""
    size = max(1, min(1000, size))
    rows = active(files).where(F.col("indexed").isin(*STATES[state]))
    if ext:
        rows = rows.where(F.endswith(F.lower("path"), F.lit(f".{ext.lower()}")))
    if text:
        rows = rows.where(F.contains(F.lower("path"), F.lit(text.lower())))
    key = {"name": F.lower(S.file_name("path")), "path": F.col("path"), "ext": S.extension_of("path"), "size": F.col("size"), "mtime": F.col("mtime")}[sort]
    order = [key.asc() if ascending else key.desc(), F.asc("path"), F.asc("id")]
    first = (max(1, page) - 1) * size
    return rows.select("id", "path", S.file_name("path").alias("name"), S.extension_of("path").alias("ext"), "dir_id", "size", "mtime", "indexed").orderBy(*order).offset(first).limit(size)


def duplicates(files: DataFrame) -> DataFrame:
    """`md5`, `n`, `paths` (sorted) of content that more than one active file has.

    Members are counted first, so the paths are gathered only of content with copies.
    """
    some = active(files).where(F.btrim("md5", F.lit(OUTER_SPACE)) != "")
    many = some.groupBy("md5").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return some.join(many, "md5").groupBy("md5", "n").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def duplicate_members(files: DataFrame) -> DataFrame:
    """`md5`, `id`, `n`: one row per active file whose content others have; nothing is gathered, whatever a group's size."""
    some = active(files).where(F.btrim("md5", F.lit(OUTER_SPACE)) != "")
    many = some.groupBy("md5").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return some.select("md5", "id").join(many, "md5")


def ocr_files(files: DataFrame, contents: DataFrame) -> DataFrame:
    """One row `n`: active files whose content came from OCR."""
    seen = contents.where("ocr_used = 1").select("md5").distinct()
    return active(files).join(seen, "md5", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def orphan_contents(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Contents that no file refers to, whatever its status."""
    return contents.join(files.select("md5").where("md5 is not null").distinct(), "md5", "left_anti")


def preview(files: DataFrame, contents: DataFrame) -> DataFrame:
    """`id`, `kind`, `n_chars`, `ocr_used` of each file, by its content's hash; null without content."""
    known = contents.select("md5", F.char_length("text_content").alias("n_chars"), "ocr_used").dropDuplicates(["md5"])
    return files.join(known, "md5", "left").select("id", S.classify_ext(S.extension_of("path")).alias("kind"), "n_chars", "ocr_used")


def directory_stats(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Every directory with the counts of its active files, zeros for none."""
    stats = status_counts(files.withColumn("dir_id", F.lower(F.btrim("dir_id", F.lit(OUTER_SPACE)))), "dir_id")
    joined = dirs.join(stats, dirs["id"] == stats["dir_id"], "left").select(dirs["id"], dirs["path"], "total", "indexed", "pending", "failed")
    return joined.fillna(0, ["total", "indexed", "pending", "failed"])


def top_words(texts: DataFrame, text: str, k: int, minimum_bytes: int = 2) -> DataFrame:
    """`word`, `n` of the most frequent words of at least `minimum_bytes` bytes that aren't all digits; ties by word."""
    from ..functions.analysis import tokens

    word = texts.select(F.explode(tokens(text)).alias("word")).where((F.octet_length("word") >= minimum_bytes) & ~F.col("word").rlike("^[0-9]+$"))
    return word.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k)


def unsupported(files: DataFrame) -> DataFrame:
    """`dir_id`, `ext`, `n` of files with an extension that isn't supported; none is ignored."""
    ext = F.lower(F.col("file_ext"))
    rows = files.where((F.col("file_ext") != "") & ~S.is_supported(ext))
    return rows.groupBy("dir_id", ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def recent(df: DataFrame, when: str, key: str, k: int) -> DataFrame:
    """The newest `k` rows; ties by key."""
    return df.orderBy(F.desc(when), F.asc(key)).limit(k)


def needing_index(files: DataFrame, k: int) -> DataFrame:
    """The `k` files that wait longest: pending or failed, oldest update first."""
    return files.where(F.col("indexed").isin(0, 2)).orderBy("updated_at", "id").limit(k)


def retained(df: DataFrame, when: str, key: str, keep: int, by: str | None = None) -> DataFrame:
    """All rows (`key` is unique) with whether they are `kept`, as the newest `keep` (of each `by`), and the `rank` of those that are.

    Rows are cut to `keep` before any is ranked by one task, and the ranks are joined back
    to the table.  Equal times are in order of `key`; an empty table gives none.
    """
    order = [F.desc(when), F.asc(key)]
    if by:
        # the newest of parts first, so a `by` with a third of all rows is spread over many tasks
        part = df.select(key, when, by, F.pmod(F.xxhash64(key), F.lit(64)).alias("__part"))
        first = part.withColumn("__r", F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order))).where(F.col("__r") <= keep)
        top = first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    else:
        top = df.select(key, when).orderBy(*order).limit(keep).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return df.join(top.where(F.col("rank") <= keep).select(key, "rank"), key, "left").withColumn("kept", F.col("rank").isNotNull())


def directory_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """`path`, `parent`, `depth`, `name`, `n_files` of every directory above the paths (parts between slashes; the root is '')."""
    parts = F.filter(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    above = paths.select(parts.alias("p")).where(F.size("p") > 1)
    each = above.select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("depth"))
    named = each.select(F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("path"), F.array_join(F.slice("p", 1, F.col("depth") - 1), "/").alias("parent"), "depth", F.element_at("p", F.col("depth")).alias("name"))
    return named.groupBy("path", "parent", "depth", "name").agg(F.count(F.lit(1)).alias("n_files"))


def under_root(paths: DataFrame, roots: DataFrame, path: str, root: str, root_id: str) -> DataFrame:
    """Each path with the id of the longest root above it, by whole components; null without one.

    Every prefix of a path that ends at a slash is looked up by equality, so there is
    no comparison of all paths with all roots.
    """
    clean = F.rtrim(F.replace(F.col(path), F.lit("\\"), F.lit("/")), F.lit("/"))
    tagged = paths.withColumn("__p", clean)
    parts = F.split("__p", "/")
    prefixes = tagged.select("__p").distinct().select("__p", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("__root"))
    known = roots.select(F.rtrim(F.replace(F.col(root), F.lit("\\"), F.lit("/")), F.lit("/")).alias("__root"), F.col(root_id).alias("__id")).groupBy("__root").agg(F.min("__id").alias("__id"))
    best = prefixes.join(known, "__root").groupBy("__p").agg(F.max_by("__id", F.length("__root")).alias("root_id"))
    return tagged.join(best, "__p", "left").drop("__p")


def log_session(lines: DataFrame, number: str, text: str, marker: str, by: str | None = None) -> DataFrame:
    """The lines (of each `by`) from the last one that contains `marker` on; all of them if none does."""
    at = F.max(F.when(F.contains(F.col(text), F.lit(marker)), F.col(number))).alias("__last")
    last = lines.groupBy(by).agg(at) if by else lines.agg(at)
    both = lines.join(last, by, "left") if by else lines.crossJoin(F.broadcast(last))  # one row
    return both.where(F.col("__last").isNull() | (F.col(number) >= F.col("__last"))).drop("__last")


def log_tail(lines: DataFrame, number: str, k: int) -> DataFrame:
    """The last `k` lines in order."""
    return lines.orderBy(F.desc(number)).limit(k).orderBy(number)


def tagged_lines(lines: DataFrame, text: str, tag: str) -> DataFrame:
    """Lines with a `[tag]`; for the tag ERROR those with that word in large or small letters."""
    c = F.col(text)
    return lines.where(F.contains(c, F.lit("ERROR")) | F.contains(c, F.lit("error")) if tag.upper() == "ERROR" else F.contains(c, F.lit(f"[{tag}]")))


# Extensions that count as images.
IMAGES = ("png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp")


def image_files(files: DataFrame) -> DataFrame:
    """One row `n`: active files with the extension of an image, in any case."""
    return active(files).where(F.lower("file_ext").isin(*IMAGES)).agg(F.count(F.lit(1)).alias("n"))


def last_scan(settings: DataFrame, prefix: str = "last_scan_") -> DataFrame:
    """One row `last_scan`: the greatest number among settings whose key begins with `prefix`; null without any."""
    return settings.where(F.startswith("key", F.lit(prefix))).agg(F.max(F.expr("try_cast(value as bigint)")).alias("last_scan"))


def file_detail(files: DataFrame, key: str) -> DataFrame:
    """One file's columns (none if it is unknown), `indexed` as a boolean."""
    return files.where(F.col("id") == key).withColumn("indexed", F.col("indexed") == 1)


def files_of(files: DataFrame, directory: str) -> DataFrame:
    """The files of one directory by path."""
    return files.where(F.col("dir_id") == directory).orderBy("path", "id")


def list_files(files: DataFrame, page: int = 1, size: int = 50, directory: str | None = None) -> DataFrame:
    """One page of files, whatever their state, by path."""
    rows = files if directory is None else files.where(F.col("dir_id") == directory)
    return rows.orderBy("path", "id").offset((max(1, page) - 1) * max(0, size)).limit(max(0, size))


def type_list(types: DataFrame, which: str = "all") -> DataFrame:
    """Rows `ext`, `n`, `available` of all types, of those whose reader is `missing`, or of those that have `files`."""
    return {"all": types, "missing": types.where(~F.col("available")), "files": types.where("n > 0")}[which]


def subtree(tree: DataFrame, path: str) -> DataFrame:
    """A directory of a tree and all directories below it."""
    return tree.where((F.col("path") == path) | F.startswith("path", F.lit(path.rstrip("/") + "/")))


def partly_selected(tree: DataFrame, chosen: list[str]) -> DataFrame:
    """The directories above a chosen one that are not chosen themselves."""
    above = sorted({"/".join(c.split("/")[:i]) for c in chosen for i in range(1, len(c.split("/")))} - set(chosen))
    return tree.where(F.col("path").isin(above))


def scan_delta(summaries: DataFrame) -> DataFrame:
    """Changes of several directories (`dir_id`, `change`, `n`) in one row per change."""
    return summaries.groupBy("change").agg(F.sum("n").alias("n"))


def count_files(listing: DataFrame, seconds: float = 3.0) -> int:
    """The number of files of a listing if it can be counted within `seconds`, else 0 for not known; only progress bars use it."""
    partial = listing.where("not is_dir")._jdf.toJavaRDD().countApprox(int(seconds * 1000), 0.95)
    found = partial.initialValue()
    return int(found.mean()) if found.low() == found.high() else 0
