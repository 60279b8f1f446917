"""Caption-pair shaping: projections, splits, unpivots, unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.indexing import _col, is_expensive, row_index
from ..session import cut_lineage
from .batching import seeded_key


def select_pair(df: DataFrame, student_col: str, teacher_col: str, id_col: str = "id") -> DataFrame:
    """Name the column that feeds the student and the one that feeds the teacher."""
    return df.select(F.col(id_col), F.col(student_col).alias("student_text"), F.col(teacher_col).alias("teacher_text"))


def prune_columns(df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] | None = None) -> DataFrame:
    """Keep only ``keep``, or drop ``drop``, or leave the table as it is."""
    if keep is not None:
        return df.select(*keep)
    if drop is not None:
        return df.drop(*drop)
    return df


def resolve_columns(df: DataFrame, image_col: str | None = None, caption_col: str | None = None,
                    mapping: Mapping[str, tuple[str, str]] | None = None,
                    dataset: str | None = None) -> tuple[str, str]:
    """Pick the image and caption columns before any action.

    An explicit name must exist (else ``ValueError`` listing the columns);
    otherwise the dataset mapping; otherwise the first and second columns.
    """
    cols = df.columns
    default = (mapping or {}).get(dataset or "", None)
    img = image_col or (default[0] if default else cols[0])
    cap = caption_col or (default[1] if default else cols[1])
    for name, kind in [(img, "image"), (cap, "caption")]:
        if name not in cols:
            raise ValueError(f"no column {name!r} to take the {kind} from; the table has: {', '.join(cols)}")
    return img, cap


LIMIT_DIRECT = 100_000


def take_n(df: DataFrame, n: int | None, order_by: Sequence) -> DataFrame:
    """The first min(len, n) rows in an explicit (total) order.

    A small n is a top-n (each partition keeps n rows, one task merges them);
    a large n numbers the rows with ``row_index`` instead, so no task receives
    n x partitions rows. Keys sort ascending at every n; a key with a direction is an error.
    """
    if n is None:
        return df
    order_by = [_col(o) for o in order_by]
    if n <= LIMIT_DIRECT:
        return df.orderBy(*order_by).limit(n)
    return row_index(df, order_by, name="_pl_rn").filter(F.col("_pl_rn") <= n).drop("_pl_rn")


def exact_split(df: DataFrame, id_col: str, test_size: int, seed: int,
                split_col: str = "split") -> DataFrame:
    """P5: exactly ``test_size`` validation rows (smallest md5(id:seed), then id), the rest train.

    md5 is uniform, so its leading 15 hex digits give a threshold that lets
    about ``test_size`` rows through. If at least ``test_size`` rows pass, the
    smallest ones all passed; the exact cut is then a top-n over those few
    candidates only (not over every partition's top-n). The threshold widens
    until enough rows pass. Only the key of the last validation row comes to the driver; every row is
    then labelled by comparing its own key, without a join.
    """
    key = seeded_key(id_col, seed)
    keyed = df.select(F.col(id_col), key.alias("_k"),
                      F.conv(F.substring(key, 1, 15), 16, 10).cast("decimal(20,0)").alias("_u"))
    n = df.count()
    full = 16 ** 15
    frac = min(1.0, (test_size + 10 * test_size ** 0.5 + 100) / max(n, 1))
    while True:
        limit = int(full * frac) if frac < 1.0 else full
        cand = keyed.filter(F.col("_u") < F.lit(limit).cast("decimal(20,0)"))
        if frac >= 1.0 or cand.count() >= test_size:
            break
        frac = min(1.0, frac * 2)
    if test_size >= n:
        chosen = F.lit(test_size > 0)
    elif test_size <= LIMIT_DIRECT:
        last = cand.orderBy("_k", id_col).limit(test_size).agg(F.max(F.struct("_k", id_col)).alias("m")).first()["m"]
        chosen = F.lit(False) if last is None else _upto(key, F.col(id_col), last)
    else:
        last = row_index(cand.select("_k", id_col), ["_k", id_col], name="_rn").filter(F.col("_rn") == test_size).first()
        chosen = _upto(key, F.col(id_col), last)
    return df.withColumn(split_col, F.when(chosen, F.lit("validation")).otherwise(F.lit("train")))


def _upto(key: Column, ids: Column, last) -> Column:
    """(key, id) is not after the (key, id) of the row ``last``."""
    return (key < F.lit(last[0])) | ((key == F.lit(last[0])) & (ids <= F.lit(last[1])))


def unpivot_captions(df: DataFrame, id_col: str, langs: Sequence[str], target_lang: str = "en") -> DataFrame:
    """One row per (item, language) with a caption: input = that language, target = English.

    Includes the English-to-English row, as the reference does. Only a missing caption of the row's own
    language drops the row; a missing target stays null.
    """
    entries = F.array(*[F.struct(F.lit(l).alias("lang"), F.col(l).alias("text")) for l in langs])
    ex = df.select(F.col(id_col), F.col(target_lang).alias("_t"), F.explode(entries).alias("e"))
    return (ex.filter(F.col("e.text").isNotNull())
              .select(id_col, F.col("e.lang").alias("lang"), F.col("e.text").alias("source_text"),
                      F.col("_t").alias("target_text")))


def unpivot_caption_maps(df: DataFrame, id_col: str, maps_col: str, target_lang: str = "en") -> DataFrame:
    """P7 on ``array<map<lang, caption>>``: a row per map and language with a caption (``item`` numbers the maps from 0)."""
    items = df.select(F.col(id_col), F.posexplode(maps_col).alias("item", "_m"))
    ex = items.select(id_col, "item", F.try_element_at("_m", F.lit(target_lang)).alias("_t"), F.explode("_m").alias("lang", "text"))
    return ex.filter(F.col("text").isNotNull()).select(id_col, "item", "lang", F.col("text").alias("source_text"), F.col("_t").alias("target_text"))


def stack_captions(df: DataFrame, id_col: str, lang_cols: Sequence[str]) -> DataFrame:
    """Captions of several language columns, language-major order (``ord`` 0-based)."""
    entries = F.array(*[F.struct(F.lit(i).alias("li"), F.lit(l).alias("lang"), F.col(l).alias("caption"))
                        for i, l in enumerate(lang_cols)])
    ex = (df.select(F.col(id_col), F.explode(entries).alias("e"))
            .filter(F.col("e.caption").isNotNull())
            .select(id_col, "e.li", "e.lang", "e.caption"))
    return row_index(ex, ["li", id_col], name="ord", start=0).drop("li")


def language_subset(df: DataFrame, lang_col: str, langs: Sequence[str]) -> DataFrame:
    """Keep the given languages (two-language or six-language sets)."""
    return df.filter(F.col(lang_col).isin(list(langs)))


def require_splits(df: DataFrame, split_col: str, names: Sequence[str]) -> DataFrame:
    """P10: error when a requested split is missing; returns rows per present split."""
    counts = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
    present = {r[split_col] for r in counts.select(split_col).collect()}  # one row per split
    missing = [n for n in names if n not in present]
    if missing:
        raise ValueError(f"no rows for the split {missing[0]!r}")
    return counts.filter(F.col(split_col).isin(list(names)))


def bilingual_double(pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """Student side = other-language rows then English rows; teacher side = English twice."""
    a = pairs.select(id_col, F.lit(0).alias("part"), F.col("target_text").alias("student_text"),
                     F.col("source_text").alias("teacher_text"))
    b = pairs.select(id_col, F.lit(1).alias("part"), F.col("source_text").alias("student_text"),
                     F.col("source_text").alias("teacher_text"))
    return a.unionByName(b)


def ordered_union_distinct(a, b) -> Column:
    """Concatenation of two arrays keeping the first occurrence of each value."""
    ca = F.col(a) if isinstance(a, str) else a
    cb = F.col(b) if isinstance(b, str) else b
    return F.array_distinct(F.concat(ca, cb))


def _earliest(rows: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """For each id the row of its earliest ``_part``."""
    one = rows.groupBy(id_col).agg(F.min_by(F.struct(*cols), "_part").alias("_r"))
    return one.select(id_col, *[F.col("_r")[c].alias(c) for c in cols])


def concat_parts(parts: Sequence[DataFrame], id_col: str, pad: Mapping[str, int] | None = None,
                 pad_value: int = -100) -> DataFrame:
    """U4: per-batch outputs as one table; a row repeated by padding appears once, as in its earliest part.

    Array columns in ``pad`` are right-padded with ``pad_value`` to that width, or to the widest row if that is wider,
    so the result is rectangular.
    """
    cols = [c for c in parts[0].columns if c != id_col]
    pad = pad or {}
    out = None
    for i, p in enumerate(parts):
        p = cut_lineage(p, "parts") if pad and is_expensive(p) else p  # read for repeated ids, for the widest row and for the result
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    if pad:  # only ids are grouped, and the rows of those that come again
        ids = cut_lineage(out.groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_again"), "repeated-ids")
        again = F.col(id_col).eqNullSafe(F.col("_again"))
        once = out.join(ids, again, "left_anti").select(id_col, *cols)
        out = once.unionByName(_earliest(out.join(ids, again, "left_semi"), id_col, cols))
    else:
        out = _earliest(out, id_col, cols)
    widest = out.agg(*[F.max(F.size(c)).alias(c) for c in pad]).first() if pad else {}
    for c, width in pad.items():
        full = max(width, widest[c] or 0)
        fill = F.lit(pad_value).cast(out.schema[c].dataType.elementType)
        out = out.withColumn(c, F.concat(F.col(c), F.array_repeat(fill, F.lit(full) - F.size(c))))
    return out


def attach_vectors(rows: DataFrame, vecs: DataFrame, id_col: str) -> DataFrame:
    """Vectors next to their source rows (rows without a vector keep a null)."""
    return rows.join(vecs, id_col, "left")
