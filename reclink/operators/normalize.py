"""Normalised records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.functions import constants as K
from reclink.functions import text
from reclink.operators import translit


def normalize(records: DataFrame, maps: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add the normalised name and address columns.

    ``maps``: learned dictionaries ``k, v`` by ``name`` and ``addr`` (see ``translit``); they replace tokens of names and components of addresses
    in Indic scripts first. Without them no row is moved. ``nm_native`` is about the name as it came, ``nm_nonascii`` about the replaced one.
    """
    out = records.withColumn("nm_native", F.coalesce(F.col("business_name").rlike(K.NATIVE), F.lit(False)))
    if maps:
        out = translit.apply_names(translit.apply_addresses(out, maps["addr"]), maps["name"])
    name, address = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    out = out.withColumns(text.name_columns(name) | text.address_columns(address) | {"nm_nonascii": name.rlike(r"[^\x00-\x7F]")})
    return out.withColumns({
        "nm_core": F.array_join("nm_tok", " "), "nm_concat": F.array_join("nm_tok", ""),
        "ad_first_num": F.get("ad_nums", 0), "ad_num": F.array_distinct("ad_nums"),
    }).drop("ad_nums")
