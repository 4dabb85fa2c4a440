"""Remote repositories, cloned on the driver and then read as a tree."""

from __future__ import annotations

import ipaddress
import subprocess
import tempfile
from pathlib import Path
from urllib.parse import urlparse


def _private(host: str) -> bool:
    if host == "localhost" or host.endswith(".local"):
        return True
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return False
    return address.is_private or address.is_loopback


def check_url(url: str) -> None:
    """https, or http to a private host; ValueError otherwise."""
    parsed = urlparse(url)
    if not parsed.hostname or not (parsed.scheme == "https" or (parsed.scheme == "http" and _private(parsed.hostname))):
        raise ValueError(f"not an allowed address: {url!r}")


def clone(url: str) -> Path:
    """A shallow clone in a new folder of the driver."""
    check_url(url)
    target = Path(tempfile.mkdtemp(prefix="corpusloom-clone-"), "repo")
    subprocess.run(["git", "clone", "--depth", "1", "--", url, str(target)], check=True, capture_output=True)
    return target
