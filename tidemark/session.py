"""Logins: an engine behind names and passwords, for programs that hand it on to others.

    gate = Gate(engine, {"ann": "secret"})
    token = gate.login("ann", "secret")
    gate.session(token).query("SELECT 1")

A token is good until it is taken back or the gate is gone. Without a good one
there is no session, and a session whose token is taken back does nothing more.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import threading
import uuid
from collections.abc import Callable

from .engine import Engine
from .errors import AuthError

ALLOWED = ("query", "execute", "table", "create_table", "add_column", "drop_table", "write", "bulk_load", "load_file", "flush", "compact", "memory_stats")


class Gate:
    def __init__(self, engine: Engine, users: dict[str, str]) -> None:
        self._engine, self._salt, self._lock = engine, os.urandom(16), threading.Lock()
        self._users = {user: self._digest(password) for user, password in users.items()}
        self._tokens: dict[str, str] = {}

    def _digest(self, password: str) -> bytes:
        return hashlib.pbkdf2_hmac("sha256", password.encode(), self._salt, 50_000)

    def login(self, user: str, password: str) -> str:
        # An unknown name costs as much as a wrong password.
        known = self._users.get(user, b"")
        if not hmac.compare_digest(known, self._digest(password)) or not known:
            raise AuthError("wrong name or password")
        token = uuid.uuid4().hex
        with self._lock:
            self._tokens[token] = user
        return token

    def logout(self, token: str) -> None:
        with self._lock:
            self._tokens.pop(token, None)

    def user(self, token: str) -> str:
        with self._lock:
            if token not in self._tokens:
                raise AuthError("no such token: log in first")
            return self._tokens[token]

    def session(self, token: str) -> "Session":
        self.user(token)
        return Session(self, token)


class Session:
    """The engine's methods, each for as long as the token is good."""

    def __init__(self, gate: Gate, token: str) -> None:
        self._gate, self._token = gate, token

    def __getattr__(self, name: str) -> Callable:
        if name not in ALLOWED:
            raise AttributeError(name)

        def call(*args, **kw):
            self._gate.user(self._token)
            return getattr(self._gate._engine, name)(*args, **kw)

        return call
