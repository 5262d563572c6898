"""CREATE STREAM: its text, and which options each sink takes.

A stream exports the changes of one table to one sink. Options are checked in
full before anything starts; unknown keys and keys of another sink are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import StreamError
from ..functions.literals import Reader, tokens

SECRET = re.compile(r"(secret\.key|password|auth-params|jaas\.config|access\.key)$")

# Option names, defaults and the words they take.
SINKS = {"delta": "delta", "kafka": "kafka", "filesystem": "filesystem", "fs": "filesystem", "file": "filesystem", "iceberg": "iceberg", "pulsar": "pulsar", "mqtt": "mqtt", "noop": "noop"}
FORMATS = {"delta": "parquet", "filesystem": "parquet", "iceberg": "parquet", "kafka": "json", "pulsar": "json", "mqtt": "json", "noop": "noop"}
MODES = {"batch": "batch", "historical": "batch", "hybrid": "hybrid", "full": "hybrid"}
MESSAGE_SINKS = ("kafka", "pulsar", "mqtt")

_S3 = {"endpoint": None, "access.key": None, "secret.key": None, "region": "us-east-1", "path.style.access": None, "connection.maximum": "500", "connection.timeout": "200s", "attempts.maximum": "20"}
_KEYS = {"key.format": "json", "key.fields": None, "key.fields-prefix": ""}
OPTIONS: dict[str, dict[str, str | None]] = {
    "filesystem": {"path": None, **_S3},
    "delta": {"path": None, **_S3},
    "kafka": {
        "brokers": None, "topic": None, **_KEYS, "partitioner": "default", "delivery-guarantee": "at-least-once", "transactional.id": None, "transaction.timeout.ms": "900000",
        "compression.type": None, "batch.size": None, "linger.ms": None, "acks": None, "retries": None, "security.protocol": None, "sasl.mechanism": None, "sasl.username": None,
        "sasl.password": None, "sasl.jaas.config": None, "ssl.ca.location": None, "ssl.truststore.location": None, "ssl.certificate.location": None, "ssl.key.location": None, "ssl.key.password": None,
    },
    "iceberg": {"catalog-type": None, "catalog-name": None, "namespace": None, "table": None, "uri": None, "warehouse": None, "create-table-if-not-exists": "true", **_S3},
    "pulsar": {"topic": None, "service-url": None, "admin-url": None, "delivery-guarantee": "at-least-once", **_KEYS, "auth-plugin": None, "auth-params": None},
    "mqtt": {
        "url": None, "server-uri": None, "topic": None, "client-id": None, "username": None, "password": None, "clean-session": "true", "qos": "1", "retained": "false",
        "connection-timeout": "30", "keep-alive-interval": "60", "max-inflight": "1000",
    },
    "noop": {},
}
REQUIRED = {"filesystem": ["path"], "delta": ["path"], "kafka": ["brokers", "topic"], "iceberg": ["catalog-type", "catalog-name", "namespace", "table"], "pulsar": ["topic", "service-url", "admin-url"], "mqtt": ["topic"], "noop": []}


@dataclass
class StreamDef:
    name: str
    table: str
    sink: str
    mode: str
    auto_end: bool
    options: dict[str, str] = field(default_factory=dict)
    #: As written, for SHOW STREAM.
    given: dict[str, str] = field(default_factory=dict)

    def statement(self) -> str:
        """The statement again, secrets struck out."""
        show = lambda k, v: "******" if SECRET.search(k) else v.replace("'", "''")
        given = dict(self.given) | {"cdc.mode": self.mode, "cdc.auto_end": str(self.auto_end).lower()}
        return f"CREATE STREAM {self.name} WITH (" + ", ".join(f"'{k}'='{show(k, v)}'" for k, v in sorted(given.items())) + ")"

    def plan(self) -> str:
        steps = ["prepare log", "sync batch"] if self.mode == "hybrid" else ["sync batch"]
        return " -> ".join([*steps, "complete" if self.auto_end else "activate"])


def boolean(key: str, v: str) -> bool:
    if v.lower() in ("true", "1", "yes"):
        return True
    if v.lower() in ("false", "0", "no"):
        return False
    raise StreamError(f"invalid boolean for {key}: {v}")


def duration_ms(key: str, v: str) -> int:
    m = re.fullmatch(r"(\d+)\s*(ms|s|m|min|h)?", v.strip())
    if not m:
        raise StreamError(f"invalid duration for {key}: {v}")
    return int(m[1]) * {"ms": 1, None: 1, "s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000}[m[2]]


def parse(sql: str) -> tuple[StreamDef, bool]:
    """(definition, if not exists)"""
    t = tokens(sql)
    while t and t[-1] == ";":
        t.pop()
    r = Reader(t)
    r.take("CREATE")
    r.take("STREAM")
    exists = r.peek().upper() == "IF"
    if exists:
        for w in ("IF", "NOT", "EXISTS"):
            r.take(w)
    name = r.name()
    if r.peek().upper() != "WITH":
        raise StreamError("CREATE STREAM needs WITH (...)")
    r.take()
    r.take("(")
    given: dict[str, str] = {}
    while r.peek() != ")":
        if r.peek() == ",":
            r.take()
            continue
        k = r.take()
        r.take("=")
        v = r.take()
        if k[0] != "'" or v[0] != "'":
            raise StreamError("stream options are 'key' = 'value'")
        key = k[1:-1]
        if key in given:
            raise StreamError(f"option {key} is given twice")
        given[key] = v[1:-1].replace("''", "'")
    r.take(")")
    if r.peek():
        raise StreamError(f"unexpected {r.peek()}")
    return define(name, given), exists


def define(name: str, given: dict[str, str]) -> StreamDef:
    kind = given.get("sink.type")
    if not kind:
        raise StreamError("sink.type is required")
    sink = SINKS.get(kind.lower())
    if not sink:
        raise StreamError(f"unknown sink type {kind}")
    source = given.get("source.table", "")
    if not source or "," in source:
        raise StreamError("source.table must name exactly one table")
    mode = given.get("cdc.mode", "hybrid" if sink in MESSAGE_SINKS else "batch").lower()
    if mode not in MODES:
        raise StreamError(f"unsupported cdc.mode {mode}")
    auto_end = boolean("cdc.auto_end", given.get("cdc.auto_end", "false"))
    if given.get("sink.format", FORMATS[sink]).lower() != FORMATS[sink]:
        raise StreamError(f"sink.format of {sink} must be {FORMATS[sink]}")
    options = {k: v for k, v in OPTIONS[sink].items() if v is not None}
    for key, v in given.items():
        if key in ("sink.type", "source.table", "cdc.mode", "cdc.auto_end", "sink.format"):
            continue
        prefix = f"sink.{sink}."
        short = key.removeprefix(prefix)
        if not key.startswith(prefix) or short not in OPTIONS[sink]:
            raise StreamError(f"unsupported option {key} for a {sink} sink")
        options[short] = v
    if "server-uri" in options:
        options.setdefault("url", options.pop("server-uri"))
    if "ssl.truststore.location" in options:
        options.setdefault("ssl.ca.location", options.pop("ssl.truststore.location"))
    missing = [k for k in REQUIRED[sink] if not options.get(k)]
    if missing:
        raise StreamError(f"missing option sink.{sink}.{missing[0]}")
    CHECKS.get(sink, lambda o: None)(options)
    return StreamDef(name, source, sink, MODES[mode], auto_end, options, given)


def one_of(o: dict, key: str, *words: str) -> None:
    if key in o and o[key].lower() not in words:
        raise StreamError(f"{key} must be one of {', '.join(words)}")


def _storage(o: dict) -> None:
    for k in ("connection.maximum", "attempts.maximum"):
        if not o[k].isdigit():
            raise StreamError(f"invalid number for {k}: {o[k]}")
    duration_ms("connection.timeout", o["connection.timeout"])
    o["path.style.access"] = str(boolean("path.style.access", o.get("path.style.access") or str("endpoint" in o))).lower()


def _path(o: dict) -> None:
    _storage(o)
    scheme = o["path"].split("://")[0] if "://" in o["path"] else "file"
    if scheme not in ("file", "s3", "s3a"):
        raise StreamError(f"unsupported path scheme {scheme}")


def _message_keys(o: dict) -> None:
    one_of(o, "key.format", "json")
    if o.get("key.fields-prefix") and not o.get("key.fields"):
        raise StreamError("key.fields-prefix needs key.fields")


def _kafka(o: dict) -> None:
    _message_keys(o)
    one_of(o, "partitioner", "default", "round-robin", "fixed")
    one_of(o, "delivery-guarantee", "at-least-once", "exactly-once", "none")
    one_of(o, "compression.type", "none", "gzip", "snappy", "lz4", "zstd")
    one_of(o, "acks", "0", "1", "all", "-1")
    if o["delivery-guarantee"] == "exactly-once" and o.get("acks", "all") not in ("all", "-1"):
        raise StreamError("exactly-once needs acks all")
    jaas = o.pop("sasl.jaas.config", None)
    if jaas:
        for part in ("username", "password"):
            m = re.search(rf'{part}="([^"]*)"', jaas)
            if not m:
                raise StreamError(f"sasl.jaas.config lacks {part}")
            o.setdefault(f"sasl.{part}", m[1])


def _iceberg(o: dict) -> None:
    _storage(o)
    one_of(o, "catalog-type", "hive", "hadoop", "rest", "glue")
    kind = o["catalog-type"].lower()
    if kind in ("hive", "rest") and not o.get("uri"):
        raise StreamError(f"catalog-type {kind} needs uri")
    if kind == "hadoop" and not o.get("warehouse"):
        raise StreamError("catalog-type hadoop needs warehouse")
    boolean("create-table-if-not-exists", o["create-table-if-not-exists"])


def _pulsar(o: dict) -> None:
    _message_keys(o)
    one_of(o, "delivery-guarantee", "at-least-once", "none")
    if o.get("auth-params") and not o.get("auth-plugin"):
        raise StreamError("auth-params needs auth-plugin")
    if o.get("auth-plugin") and "token" not in o["auth-plugin"].lower():
        raise StreamError("only token authentication is supported")


def _mqtt(o: dict) -> None:
    if not o.get("url"):
        raise StreamError("missing option sink.mqtt.url")
    one_of(o, "qos", "0", "1", "2")
    if o.get("password") and not o.get("username"):
        raise StreamError("password needs username")
    if not boolean("clean-session", o["clean-session"]) and not o.get("client-id"):
        raise StreamError("clean-session=false needs client-id")
    boolean("retained", o["retained"])
    for k in ("connection-timeout", "keep-alive-interval", "max-inflight"):
        if not o[k].rstrip("s").isdigit():
            raise StreamError(f"invalid number for {k}: {o[k]}")
    if int(o["max-inflight"]) < 1:
        raise StreamError("max-inflight must be at least 1")


CHECKS = {"filesystem": _path, "delta": _path, "kafka": _kafka, "iceberg": _iceberg, "pulsar": _pulsar, "mqtt": _mqtt}
