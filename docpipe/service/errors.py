"""Error codes with their status and default message."""

from __future__ import annotations

#: Code -> (status, message).
CODES = {
    "400-1": ("ERROR", "Invalid request"),
    "400-2": ("ERROR", "Entry size exceeds maximum allowed size"),
    "400-3": ("ERROR", "Duplicate _id in bulk save request"),
    "400-4": ("ERROR", "Cannot delete the last admin user"),
    "400-5": ("ERROR", "Cannot demote the last admin user"),
    "400-6": ("ERROR", "Current password is incorrect"),
    "401-1": ("UNAUTHENTICATED", "Must authenticate first"),
    "401-2": ("UNAUTHENTICATED", "User no longer exists"),
    "401-3": ("ERROR", "The user doesn't exist or the wrong credentials have been provided"),
    "403-1": ("FORBIDDEN", "Action is forbidden, no permissions"),
    "404-1": ("NOT_FOUND", "User not found"),
    "404-2": ("NOT_FOUND", "Entry not found"),
    "404-3": ("NOT_FOUND", "No results"),
    "404-4": ("NOT_FOUND", "Database not found"),
    "404-5": ("NOT_FOUND", "No users found"),
    "404-6": ("NOT_FOUND", "No index registered for the specified field"),
    "404-7": ("NOT_FOUND", "Listen registration not found"),
    "409-1": ("ERROR", "User already exists"),
    "409-2": ("ERROR", "Database already exists"),
    "500-1": ("ERROR", "Error during authentication"),
    "500-2": ("ERROR", "Error creating user"),
    "500-3": ("ERROR", "Error deleting user"),
    "500-4": ("ERROR", "Error changing password"),
    "500-5": ("ERROR", "Error changing permissions"),
    "500-6": ("ERROR", "Error while saving entries"),
    "500-7": ("ERROR", "Error while saving entry"),
    "500-8": ("ERROR", "Error while retrieving entry"),
    "500-9": ("ERROR", "Error while processing aggregation"),
    "500-10": ("ERROR", "Error while deleting entry"),
    "500-11": ("ERROR", "Error while creating database"),
    "500-12": ("ERROR", "Error updating database owners"),
    "500-13": ("ERROR", "Error while dropping database"),
    "500-14": ("ERROR", "Error while listing databases"),
    "500-15": ("ERROR", "Error while creating collection"),
    "500-16": ("ERROR", "Error while dropping collection"),
    "500-17": ("ERROR", "Error while listing collections"),
    "500-18": ("ERROR", "Error while creating index"),
    "500-19": ("ERROR", "Error listing users"),
    "500-20": ("ERROR", "Error while dropping index"),
    "500-21": ("ERROR", "Error while reindexing"),
    "500-22": ("ERROR", "Error while gathering database stats"),
    "500-23": ("ERROR", "Error while processing listen operation"),
    "503-1": ("ERROR", "Max number of connections reached"),
}


class Refused(Exception):
    """A request that gets an error response."""

    def __init__(self, code: str, message: str | None = None):
        super().__init__(message or CODES[code][1])
        self.code, self.message = code, message or CODES[code][1]

    def response(self, kind: str | None) -> dict:
        return {"type": kind, "status": CODES[self.code][0], "message": self.message, "errorCode": self.code}
