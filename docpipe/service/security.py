"""Passwords, users and what they may do."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os

from docpipe.plans.steps import Join, Step

#: Fixed values of password hashing.
ITERATIONS, SALT_BYTES, KEY_BYTES = 120_000, 16, 32
PASSWORD_MIN_LENGTH = 8
LEVELS = ("READ", "READ_WRITE")
ADMIN_ONLY = frozenset({"CREATE_USER", "DELETE_USER", "CHANGE_PERMISSIONS", "SET_DATABASE_OWNERS", "GET_DATABASE_STATS", "LIST_USERS"})
OPEN_TO_ALL = frozenset({"LIST_DATABASES", "AUTHENTICATE", "CLOSE_CONNECTION"})
OWN_CHECK = frozenset({"SET_PASSWORD", "STOP_LISTEN"})
READERS = frozenset({"FIND_BY_ID", "AGGREGATE", "LIST_COLLECTIONS", "LISTEN"})


def hash_password(password: str) -> str:
    salt = os.urandom(SALT_BYTES)
    key = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ITERATIONS, KEY_BYTES)
    return f"{ITERATIONS}:{base64.b64encode(salt).decode()}:{base64.b64encode(key).decode()}"


def password_fits(password: str, stored: str) -> bool:
    n, salt, key = stored.split(":")
    made = hashlib.pbkdf2_hmac("sha256", password.encode(), base64.b64decode(salt), int(n), KEY_BYTES)
    return hmac.compare_digest(made, base64.b64decode(key))


def new_user(password: str, admin: bool = False, global_permissions: list | None = None, database_permissions: dict | None = None, collection_permissions: dict | None = None) -> dict:
    return {
        "passwordHash": hash_password(password),
        "admin": bool(admin),
        "globalPermissions": list(global_permissions or []),
        "databasePermissions": dict(database_permissions or {}),
        "collectionPermissions": dict(collection_permissions or {}),
    }


def covers(level: str | None, needed: str) -> bool:
    return level in LEVELS and LEVELS.index(level) >= LEVELS.index(needed)


def _may_use(user: dict, database: str, collection: str | None, needed: str) -> bool:
    """A grant for the collection or for its database is enough."""
    own = user["collectionPermissions"].get(f"{database}|{collection}") if collection else None
    return covers(own, needed) or covers(user["databasePermissions"].get(database), needed)


def allowed(kind: str, database: str | None, collection: str | None, user: dict, is_owner: bool, steps: tuple[Step, ...] = ()) -> bool:
    if user["admin"] or kind in OPEN_TO_ALL:
        return True
    if kind in ADMIN_ONLY:
        return False
    if kind in OWN_CHECK:
        return True
    if kind == "CREATE_DATABASE":
        return "CREATE_DATABASE" in user["globalPermissions"]
    if kind == "DROP_DATABASE" or not database:
        return bool(database) and is_owner
    if is_owner:
        return True
    needed = "READ" if kind in READERS else "READ_WRITE"
    return _may_use(user, database, collection, needed) and all(_may_use(user, database, s.collection, "READ") for s in steps if isinstance(s, Join))
