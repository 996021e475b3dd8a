"""PR13: text normalisation (str, strip, lower, NFKD, keep ASCII; None -> 'none')."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _normalise_one(v) -> str:
    s = str(v).strip().lower()
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")


@pandas_udf(T.StringType())
def _normalise_udf(s: pd.Series) -> pd.Series:
    # distinct values are few (hazard names, severity classes): normalise each once per batch
    cache = {}
    out = []
    for v in s.tolist():
        key = None if v is None else v
        if key not in cache:
            cache[key] = _normalise_one(key)
        out.append(cache[key])
    return pd.Series(out, dtype=object)


def normalise_exact(c: Column) -> Column:
    """Exact Unicode form, Arrow-batched."""
    return _normalise_udf(c)


#: What a name is compared without: the white space around it and whatever is neither ASCII nor a Latin letter or mark.
_AROUND, _FOREIGN = "^\\s+|\\s+$", r"[^\x00-\x7F\p{IsLatin}\p{M}]"


def same_name(c: Column, name: str) -> Column:
    """Whether a text is ``name`` but for case, accents and blanks around it, by collation (JVM only).

    Equal to comparing ``normalise_exact`` for names of Latin letters with accents; it differs for letters without a base letter in
    ASCII (o with a stroke) and for control characters inside, which a collation ignores."""
    cleaned = F.regexp_replace(F.regexp_replace(c, _FOREIGN, ""), _AROUND, "")
    return F.coalesce(F.collate(cleaned, "UNICODE_CI_AI") == F.lit(name), F.lit(False))
