"""The function surface: PySpark's functions under their own names, and the few that differ.

`element_at` gives null out of range, `any` is `some`, `consecutive_id` numbers rows without gaps; everything else is
pyspark.sql.functions as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.udf import pandas_udf, udf

_PLAIN = """
col column lit expr when coalesce nvl nullif ifnull nvl2 nanvl isnull isnan equal_null greatest least asc desc
asc_nulls_first asc_nulls_last desc_nulls_first desc_nulls_last raise_error assert_true monotonically_increasing_id rand
randn hash xxhash64 broadcast current_user user session_user current_catalog current_database current_schema
count countDistinct approx_count_distinct sum sum_distinct avg mean min max first last any_value stddev std stddev_samp
stddev_pop variance var_samp var_pop skewness kurtosis corr covar_samp covar_pop median mode percentile
percentile_approx count_if max_by min_by bool_and bool_or every some bit_and bit_or bit_xor collect_list collect_set
array_agg regr_count regr_avgx regr_avgy regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy grouping
grouping_id row_number rank dense_rank percent_rank cume_dist ntile lag lead nth_value first_value last_value
upper lower ucase lcase length char_length character_length octet_length bit_length trim ltrim rtrim btrim initcap
reverse ascii char chr concat concat_ws substring substr substring_index split split_part replace regexp_replace
regexp_extract regexp_count regexp_substr regexp_instr regexp_like regexp lpad rpad repeat locate instr translate
levenshtein left right startswith endswith contains overlay format_string printf format_number find_in_set elt base64
unbase64 hex unhex bin md5 sha sha1 sha2 abs ceil ceiling floor round rint sqrt cbrt exp expm1 ln log log1p log2 log10
pow power sign signum sin cos tan cot csc sec asin acos atan atan2 sinh cosh tanh asinh acosh atanh degrees radians
factorial hypot pmod negative positive e pi try_divide width_bucket shiftleft shiftright shiftrightunsigned bit_count
bitwise_not current_date curdate current_timestamp now localtimestamp year quarter month day dayofmonth dayofweek
weekday dayofyear weekofyear hour minute second date_part datepart extract to_date to_timestamp try_to_timestamp
date_add dateadd date_sub datediff date_diff add_months months_between last_day next_day date_trunc trunc date_format
make_date make_timestamp timestamp_seconds timestamp_millis timestamp_micros unix_timestamp to_unix_timestamp
unix_seconds unix_millis unix_micros unix_date date_from_unix_date from_unixtime array size cardinality array_size
struct array_contains array_distinct array_position array_remove array_sort sort_array array_max array_min array_join
array_union array_intersect array_except arrays_overlap array_append array_prepend array_compact array_repeat arrays_zip
get slice flatten sequence transform filter exists forall aggregate zip_with create_map map_from_arrays map_from_entries
map_entries map_keys map_values map_concat map_filter transform_keys transform_values get_json_object json_tuple to_json
from_json schema_of_json explode explode_outer posexplode posexplode_outer inline inline_outer
""".split()

globals().update({name: getattr(F, name) for name in _PLAIN})


def element_at(col, extraction) -> Column:
    """An array's element from 1, or a map's value; null where there is none."""
    return F.try_element_at(col, extraction if isinstance(extraction, Column) else F.lit(extraction))


def any(col) -> Column:  # noqa: A001
    """True if one value is."""
    return F.some(col)


def to_instant(col) -> Column:
    """A timestamp without zone as the instant that it is in the session's zone, for unix_seconds and the like."""
    return F.col(col).cast("timestamp") if isinstance(col, str) else col.cast("timestamp")


def consecutive_id(frame: DataFrame, name: str) -> DataFrame:
    """frame with 0, 1, 2 ... in a column, in the order that it has: numbers within partitions, moved by their sizes.

    monotonically_increasing_id leaves gaps; a window over everything would put all rows in one task. The frame must be
    stable between two readings.
    """
    at = frame.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33))
    sizes = at.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    number = F.col("__before") + F.col("__m").bitwiseAND((1 << 33) - 1)
    return at.join(offsets, "__p").withColumn(name, number).drop("__m", "__p", "__before")


__all__ = sorted([*_PLAIN, "any", "element_at", "pandas_udf", "udf"])
