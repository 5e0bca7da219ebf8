"""What can go wrong with a provider, and the HTTP state that tells a client so."""


class SourceError(Exception):
    status = 502


class Input(SourceError):
    status = 400


class Cancelled(SourceError):
    status = 499


class Configuration(SourceError):
    status = 503


class Temporary(SourceError):
    status = 503


class Response(SourceError):
    status = 502


class Incomplete(SourceError):
    status = 502


class Unauthorized(SourceError):
    status = 403
