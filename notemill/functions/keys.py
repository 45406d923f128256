"""Normal forms of tags, note paths and link targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notemill.functions.compat import col, trim_ws


def normal_tag(tag: Column | str) -> Column:
    """Lower case, trimmed, one leading ``#`` removed, each run of white space turned into ``-``.

    Null stays null; a tag with nothing left becomes ``''`` (list forms drop it).
    """
    t = trim_ws(F.lower(col(tag)))
    return F.regexp_replace(F.regexp_replace(t, r"\A#", ""), r"(?U)\s+", "-")


def normal_tags(tags: Column | str) -> Column:
    """The distinct non-empty normal tags of an array, in first-seen order; null gives an empty array."""
    each = F.transform(F.coalesce(col(tags), F.array().cast("array<string>")), normal_tag)
    return F.array_distinct(F.filter(each, lambda t: t.isNotNull() & (t != "")))


def path_key(path: Column | str) -> Column:
    """``\\`` becomes ``/``, repeated ``/`` one, outer spaces and slashes go, lower case, a final ``.md`` dropped."""
    p = F.regexp_replace(F.translate(col(path), "\\", "/"), "/+", "/")
    p = F.lower(F.regexp_replace(p, r"(?U)\A[\s/]+|[\s/]+\z", ""))
    return F.regexp_replace(p, r"\.md\z", "")


def percent_decoded(text: Column | str) -> Column:
    """Percent escapes as UTF-8; a ``%`` without two hex digits and a ``+`` stay as they are."""
    t = F.regexp_replace(col(text), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.instr(col(text), "%") > 0, F.try_url_decode(F.regexp_replace(t, r"\+", "%2B"))).otherwise(col(text))


def folded_path(path: Column | str) -> Column:
    """``.`` and empty parts vanish, ``..`` removes the part before it (none at the root)."""
    none = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        return (
            F.when((part == ".") | (part == ""), acc)
            .when(part == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(none))
            .otherwise(F.concat(acc, F.array(part)))
        )

    full = F.array_join(F.aggregate(F.split(col(path), "/"), none, step), "/")
    # nearly all paths hold neither '.' nor '..' as a part; they skip the fold
    return F.when(col(path).rlike(r"(\A|/)\.{0,2}(/|\z)"), full).otherwise(col(path))


def target_key(source: Column | str, target: Column | str) -> Column:
    """The path key (within the source's vault) that a raw link target means.

    The target is cut at its first ``#``, percent-decoded, ``\\`` becomes ``/``, trimmed.  If nothing is left it is
    the source itself; with a leading ``/`` it starts at the vault root, otherwise in the folder of the source.
    A null target or source gives null.
    """
    src = path_key(source)
    raw = trim_ws(F.translate(percent_decoded(F.regexp_replace(col(target), r"(?s)#.*\z", "")), "\\", "/"))
    folder = F.regexp_replace(src, r"[^/]*\z", "")
    full = F.when(raw.startswith("/"), raw).otherwise(F.concat(folder, raw))
    return F.when(raw == "", src).otherwise(path_key(folded_path(full)))


def valid_vector(vec: Column | str, dimension: Column | str) -> Column:
    """Not null, as long as ``dimension``, without null, NaN or infinity, not all zero."""
    v = col(vec)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(
        v.isNotNull() & (F.size(v) == col(dimension)) & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False)
    )
