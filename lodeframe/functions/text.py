"""Text functions as column expressions, and their plain forms for the driver."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def entropy(texts: pd.Series) -> pd.Series:
    """Shannon entropy of the characters, base 2; 0 for an empty text, null for a null. Arrow batches; each text is counted by numpy."""

    def one(text: str | None) -> float | None:
        if not text:
            return None if text is None else 0.0
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts = np.bincount(codes) if codes.max() < 1 << 12 else np.unique(codes, return_counts=True)[1]
        share = counts[counts > 0] / len(codes)
        return float(-(share * np.log2(share)).sum())

    return texts.map(one, na_action="ignore").astype("float64")


def combined_sha(digests: Column) -> Column:
    """Of structs (name, sha): the digest of a single file, else the digest of all (name, digest) in order of name."""
    joined = F.array_join(F.transform(F.sort_array(digests), lambda d: F.concat(d["name"], F.lit(":"), d["sha"])), "\n")
    return F.when(F.size(digests) == 1, digests[0]["sha"]).otherwise(F.sha2(joined, 256))


#: Opening and closing quotes of a keyword in a question.
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "「": "」", "『": "』", "《": "》"}
_IDENTIFIER = r"[A-Za-z_$][\w$]*(?:[.][A-Za-z_$][\w$]*)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+|[a-z]+(?:[A-Z][a-z0-9]*)+"


def keywords(question: str, most: int = 6) -> list[str]:
    """What a question asks for: quoted spans, runs of ideographs, dotted or camel-case names; each once."""
    found = []
    for a, b in QUOTES.items():
        found += re.findall(f"{re.escape(a)}([^{re.escape(a + b)}]{{2,80}}){re.escape(b)}", question)
    found += re.findall("[一-鿿]{2,}", question)
    found += re.findall(_IDENTIFIER, question)
    return list(dict.fromkeys(x.strip() for x in found if x.strip()))[:most]


def quoted_spans(text: Column) -> Column:
    """Double-quoted spans of 2 to 80 characters."""
    return F.regexp_extract_all(text, F.lit('"([^"]{2,80})"'), 1)
