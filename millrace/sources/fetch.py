"""The seam to the outside: bytes from an HTTP address or a path, landed unchanged before they are looked at."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from millrace.errors import SourceError

Fetcher = Callable[[str], bytes]


def http_fetcher(timeout: float = 15.0) -> Fetcher:
    """GET with a time limit; any status but 200 and any failure of the connection is a ``SourceError``."""

    def fetch(url: str) -> bytes:
        try:
            with urllib.request.urlopen(url, timeout=timeout) as response:  # noqa: S310
                if response.status != 200:
                    raise SourceError(f"{url} answered {response.status}")
                return response.read()
        except TimeoutError as e:
            raise SourceError(f"{url} did not answer within {timeout:g} s") from e
        except urllib.error.HTTPError as e:
            raise SourceError(f"{url} answered {e.code}") from e
        except urllib.error.URLError as e:
            raise SourceError(f"{url} cannot be reached: {e.reason}") from e

    return fetch


def file_fetcher() -> Fetcher:
    """Reads a local path in place of an address."""

    def fetch(path: str) -> bytes:
        try:
            return Path(path).read_bytes()
        except OSError as e:
            raise SourceError(f"{path} cannot be read") from e

    return fetch


def land(address: str, target: str, fetch: Fetcher) -> str:
    """Fetch, write byte for byte to ``target`` (a raw zone), and return the path; then check that it is JSON."""
    body = fetch(address)
    path = Path(target)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)
    try:
        json.loads(body)
    except ValueError as e:
        raise SourceError(f"{address} answered no JSON") from e
    return str(path)
