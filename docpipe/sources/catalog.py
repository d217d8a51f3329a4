"""Databases, their owners and collections, and users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docpipe.plans.steps import NAME
from docpipe.sources.files import Files
from docpipe.sources.store import CollectionStore

RESERVED = "admin"


class Catalog:
    """A folder: one folder for each database with its collections, and ``admin`` with owners and users."""

    def __init__(self, spark: SparkSession, root: str, max_entry_size: int = 1 << 20):
        self.spark, self.root, self.max_entry_size = spark, root.rstrip("/"), max_entry_size
        self.files = Files(spark, root)
        self.files.make(RESERVED)
        self._stores: dict[tuple[str, str], CollectionStore] = {}

    def databases(self) -> list[str]:
        return [n for n in self.files.names() if n != RESERVED]

    def has_database(self, name: str) -> bool:
        return bool(NAME.fullmatch(name)) and name != RESERVED and self.files.exists(name)

    def create_database(self, name: str, owner: str | None = None) -> None:
        self.files.make(name)
        self.set_owners(name, [owner] if owner else [])

    def drop_database(self, name: str) -> None:
        self.files.remove(name)
        self.files.write(f"{RESERVED}/owners.json", {k: v for k, v in self._owners().items() if k != name})
        self._stores = {k: v for k, v in self._stores.items() if k[0] != name}

    def _owners(self) -> dict:
        return self.files.read(f"{RESERVED}/owners.json") or {}

    def owners(self, name: str) -> list[str]:
        return self._owners().get(name, [])

    def set_owners(self, name: str, owners: list[str]) -> None:
        self.files.write(f"{RESERVED}/owners.json", self._owners() | {name: owners})

    def collections(self, database: str) -> list[str]:
        return self.files.names(database)

    def collection(self, database: str, name: str) -> CollectionStore:
        key = (database, name)
        if key not in self._stores:
            self._stores[key] = CollectionStore(self.spark, f"{self.root}/{database}/{name}", self.max_entry_size)
        return self._stores[key]

    def has_collection(self, database: str, name: str) -> bool:
        return self.files.exists(f"{database}/{name}/pointer.json")

    def create_collection(self, database: str, name: str) -> CollectionStore:
        store = self.collection(database, name)
        store.create()
        return store

    def drop_collection(self, database: str, name: str) -> None:
        self.collection(database, name).drop()
        self._stores.pop((database, name), None)

    def users(self) -> dict[str, dict]:
        return self.files.read(f"{RESERVED}/users.json") or {}

    def put_user(self, name: str, user: dict | None) -> None:
        rest = {k: v for k, v in self.users().items() if k != name}
        self.files.write(f"{RESERVED}/users.json", rest | ({name: user} if user is not None else {}))
