"""Name keys: comparable forms of names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    """Casefold, decompose, keep letters and digits."""

    def key(name):
        if name is None:
            return None
        text = unicodedata.normalize("NFKD", name.casefold())
        return "".join(c for c in text if c.isalnum() and not unicodedata.combining(c))

    return names.map(key)


def nfkd_key(name: Column | str) -> Column:
    """Casefolded, decomposed letters and digits. ASCII names stay in the JVM; only others are sent to Python."""
    name = F.col(name) if isinstance(name, str) else name
    ascii_only = name.rlike("^[\\x00-\\x7F]*$")
    return F.when(ascii_only, F.regexp_replace(F.lower(name), "[^a-z0-9]", "")).otherwise(_decomposed(F.when(~ascii_only, name)))


# Accented Latin letters and their base letters.
ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěğģìíîïīįıķłļľñńņňòóôõöøōőŕřśşšţťùúûüūůűųýÿźżž"
PLAIN = "aaaaaaaaacccddeeeeeeeeggiiiiiiiklllnnnnoooooooorrsssttuuuuuuuuyyzzz"


def plain_key(name: Column) -> Column:
    """The same key for Latin names without leaving the JVM."""
    return F.regexp_replace(F.translate(F.lower(name), ACCENTED, PLAIN), "[^\\p{L}\\p{N}]", "")


def club_key(name: Column) -> Column:
    return plain_key(F.regexp_replace(name, "(?i)\\s+(FC|AFC)$", ""))
