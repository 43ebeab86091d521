"""License keys: expiry assignment, decoding and status on a given date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# License period, days of warning, and days shown for a license without expiry.
DEFAULT_DAYS = 365
WARNING_DAYS = 7
UNLIMITED_DAYS = 999

ENVELOPE = T.StructType(
    [
        T.StructField(
            "payload",
            T.StructType(
                [
                    T.StructField("customer", T.StringType()),
                    T.StructField("machine_id", T.StringType()),
                    T.StructField("expiry", T.StringType()),
                    T.StructField("features", T.ArrayType(T.StringType())),
                    T.StructField("issued_at", T.StringType()),
                ]
            ),
        ),
        T.StructField("signature", T.StringType()),
    ]
)
BASE64 = r"^[A-Za-z0-9+/]+={0,2}$"
LOCAL_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"


def expiry_time(issued: str, explicit_date: str, days: str) -> Column:
    """End of the explicit date if there is one, else issue time plus days (365 when missing)."""
    end_of_day = F.concat(F.col(explicit_date).cast("string"), F.lit("T23:59:59")).try_cast("timestamp_ntz")
    period = F.make_dt_interval(F.coalesce(F.col(days), F.lit(DEFAULT_DAYS)).cast("int"))
    return F.when(F.col(explicit_date).isNotNull(), end_of_day).otherwise(F.col(issued).cast("timestamp_ntz") + period)


def local_time(ts: Column) -> Column:
    """Timestamp as ISO text without zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def base64_line(text: Column) -> Column:
    """Base64 of a text on one line; Spark may break long ones, which strict decoders refuse."""
    return F.replace(F.base64(F.encode(text, "UTF-8")), F.lit("\r\n"), F.lit(""))


def encode_key(df: DataFrame, signature: Column) -> DataFrame:
    """Add ``license_key``: base64 of the JSON envelope of payload columns and signature.

    The payload columns are ``customer, machine_id, expiry, features, issued_at``; a NULL is left out.
    """
    payload = F.struct("customer", "machine_id", "expiry", "features", "issued_at")
    envelope = F.to_json(F.struct(payload.alias("payload"), signature.alias("signature")))
    return df.withColumn("license_key", base64_line(envelope))


def unbase64(text: Column) -> Column:
    """Bytes of a base64 text, NULL where it is none; the pattern spares a failed attempt per bad row."""
    return F.when(text.rlike(BASE64), F.try_to_binary(text, F.lit("base64")))


def decode_key(df: DataFrame, key: str = "license_key") -> DataFrame:
    """Add ``payload`` and ``well_formed``.

    A key is well formed when it is base64 of a JSON envelope with a payload, a signature of at least
    three ``:``-separated parts whose third is base64, and an expiry that is a local time or
    absent; an expiry of null is neither.
    """
    text = unbase64(F.col(key)).cast("string")
    parsed = df.withColumn("_e", F.from_json(text, ENVELOPE, {"mode": "PERMISSIVE"}))
    expiry = F.col("_e.payload.expiry")
    raw = F.get(F.split(F.col("_e.signature"), ":"), F.lit(2))
    signed = unbase64(raw).isNotNull()
    # only without a value, and where the name or an escaped one occurs, is the payload looked at once more
    named = F.array_contains(F.json_object_keys(F.get_json_object(text, "$.payload")), "expiry")
    absent = F.when(text.rlike(r'"expiry"|\\u'), ~F.coalesce(named, F.lit(False))).otherwise(F.lit(True))
    timed = F.when(expiry.isNull(), absent).otherwise(expiry.rlike(LOCAL_TIME) & expiry.try_cast("timestamp_ntz").isNotNull())
    fine = F.col("_e.payload").isNotNull() & F.coalesce(signed, F.lit(False)) & timed
    return parsed.withColumns({"payload": F.col("_e.payload"), "well_formed": F.coalesce(fine, F.lit(False))}).drop("_e")


def license_status(decoded: DataFrame, as_of: str, signature_ok: Column | None = None) -> DataFrame:
    """Add ``days_remaining``, ``status`` and ``login_allowed`` as of a local time.

    ``status`` is "expired" strictly after the expiry, "invalid" for malformed or wrongly signed keys,
    "expiring" with at most seven full days left, otherwise "valid". Without expiry a license stays
    valid. Signatures are checked elsewhere: pass the outcome as ``signature_ok``.
    """
    fine = F.col("well_formed") & (signature_ok if signature_ok is not None else F.lit(True))
    expiry = F.when(fine, F.col("payload.expiry").try_cast("timestamp_ntz"))
    now = F.lit(as_of).cast("timestamp_ntz")
    full_days = F.extract(F.lit("DAY"), expiry - now).cast("long")
    days = F.when(~fine, F.lit(0)).otherwise(F.coalesce(full_days, F.lit(UNLIMITED_DAYS)))
    status = (
        F.when(now > expiry, "expired")
        .when(~fine, "invalid")
        .when(F.col("days_remaining") <= WARNING_DAYS, "expiring")
        .otherwise("valid")
    )
    return (
        decoded.withColumn("days_remaining", days.cast("long"))
        .withColumn("status", status)
        .withColumn("login_allowed", F.col("status").isin("expiring", "valid"))
    )
