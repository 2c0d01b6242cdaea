"""Classes of digital transfers: operation, channel, device and means of authentication."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import classify_by_keywords, keyword_flag

#: Keywords of each class, first match wins.
OPERATIONS = [
    ("YAPE_PLIN_QR", ("YAPE", "PLIN", "BIM", "INTEROP", "QR", "PRINYAPE")),
    ("PASARELA", ("PASARELA",)),
    ("TRANSFERENCIA", ("TRANSFER", "TRF", "TIB", "TIP", " CC", "INMEDIATA", "TERCERO")),
    ("PAGO", ("PAGO", "ABONO", "PRESTAMO", "SERVICIO")),
]
CHANNELS = [("YAPE_PLIN", ("YAPE", "PLIN", "BIM")), ("PASARELA", ("PASARELA",)), ("TRANSF_INMEDIATA", ("INMEDIATA",)), ("TRANSF_TERCEROS", ("TERCERO",))]
DEVICES = [("iOS", ("IOS", "APPLE")), ("Android", ("ANDROID",)), ("Web", ("WEB", "INTERNET"))]
AUTHENTICATORS = {"otp": "OTP", "biometric": "BIOM", "digital_key": "CLAVE"}
OTHER, UNKNOWN, NOTHING = "OTRO", "DESCONOCIDO", ("NAN", "NONE", "")


def classify_operation(x: Column) -> Column:
    return classify_by_keywords(x, OPERATIONS, OTHER)


def classify_channel(x: Column) -> Column:
    """The channel's class; a missing channel is unknown, not other."""
    return F.when(F.upper(F.trim(F.coalesce(x, F.lit("")))).isin(*NOTHING), UNKNOWN).otherwise(classify_by_keywords(x, CHANNELS, OTHER))


def device_type(x: Column) -> Column:
    return classify_by_keywords(x, DEVICES, OTHER)


def authenticator_flags(x: Column) -> dict[str, Column]:
    """Without any means (missing or not applicable), and one flag for each means."""
    own = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    return {"no_authenticator": own.isin("NO APLICA", *NOTHING).cast("int"), **{n: keyword_flag(own, word) for n, word in AUTHENTICATORS.items()}}
