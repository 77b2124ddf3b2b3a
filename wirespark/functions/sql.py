"""The parsers and byte functions under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from wirespark.functions import encoding
from wirespark.functions.parsers import column, http, quic, smb, tls

#: Name in SQL -> a column function of one value.
FUNCTIONS = {
    "http_request": http.requests, "http_response": http.responses, "tls_client_hello": tls.client_hellos, "tls_server_hello": tls.server_hellos, "quic_header": quic.headers,
    "smb_header": smb.headers, "byte_entropy": column(encoding.byte_entropy, "double"), "is_http_request": column(http.is_request, "boolean"), "is_smb2": column(smb.is_smb2, "boolean"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make them known to the session, e.g. SELECT http_request(payload).path FROM packets."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(prefix + name, function.udf())
    return [prefix + name for name in FUNCTIONS]
