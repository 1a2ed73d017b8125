"""Updates of a catalog folder: manifests, packages and the state of the last check.

Plain driver-side helpers; nothing here starts a Spark job.  Signatures of
packages are checked by a function that the caller gives.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from collections.abc import Callable
from dataclasses import asdict, dataclass
from pathlib import Path


@dataclass(frozen=True)
class State:
    """What is known of the feed: the installed version and the last answers."""

    version: str = "0.0.0"
    etag: str = ""
    checked_at: str = ""
    updated_at: str = ""
    failures: int = 0


def load_state(path: str) -> State:
    """The stored state; the first one if there is none or it can't be read."""
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return State()
    names = set(State.__dataclass_fields__)
    return State(**{k: v for k, v in found.items() if k in names}) if isinstance(found, dict) else State()


def save_state(path: str, state: State) -> None:
    """Written beside and moved, so a reader never sees half of it."""
    beside = f"{path}.new"
    Path(beside).write_text(json.dumps(asdict(state), sort_keys=True))
    os.replace(beside, path)


def numbers(version: str) -> tuple[int, ...]:
    """Dotted version as numbers; what is no number counts as 0, and zeros at the end as absent."""
    out = [int(x) if x.isdigit() else 0 for x in version.removeprefix("v").split(".")]
    while out and out[-1] == 0:
        out.pop()
    return tuple(out)


@dataclass(frozen=True)
class Manifest:
    version: str
    url: str
    sha256: str
    least_client: str = "0.0.0"


def manifest_of(text: str) -> Manifest:
    found = json.loads(text)
    return Manifest(found["version"], found["url"], found["sha256"].lower(), found.get("min_client_version", "0.0.0"))


#: Fetches a URL unless its ETag is the given one: body (None if unchanged) and ETag.
Fetch = Callable[[str, str], tuple[bytes | None, str]]


def available(url: str, state: State, client: str, fetch: Fetch) -> tuple[Manifest | None, str]:
    """A newer manifest that this client can use, or None, and the feed's ETag."""
    body, etag = fetch(url, state.etag)
    if body is None:
        return None, etag
    manifest = manifest_of(body.decode())
    usable = numbers(manifest.version) > numbers(state.version) and numbers(client) >= numbers(manifest.least_client)
    return (manifest if usable else None), etag


class Refused(ValueError):
    """A package that must not be installed."""


def install(package: bytes, manifest: Manifest, folder: str, signed: Callable[[bytes], bool]) -> list[str]:
    """Checks sum and signature of a package and unpacks its JSON files into
    ``folder``, which is only touched if all of them are fit; gives their names."""
    if hashlib.sha256(package).hexdigest() != manifest.sha256:
        raise Refused("the sum of the package differs")
    if not signed(package):
        raise Refused("the package is not signed")
    top = Path(folder).resolve()
    files: dict[Path, bytes] = {}
    with zipfile.ZipFile(io.BytesIO(package)) as z:
        for item in z.infolist():
            target = (top / item.filename).resolve()
            if not target.is_relative_to(top):
                raise Refused(f"{item.filename} leaves the folder")
            if not item.is_dir() and target.suffix == ".json":
                files[target] = z.read(item)
    for target, body in files.items():
        try:
            json.loads(body)
        except ValueError as e:
            raise Refused(f"{target.name} is no JSON") from e
    for target, body in files.items():
        target.parent.mkdir(parents=True, exist_ok=True)
        beside = target.with_suffix(".new")
        beside.write_bytes(body)
        os.replace(beside, target)
    return sorted(str(t.relative_to(top)) for t in files)


def package(folder: str) -> tuple[bytes, dict[str, str]]:
    """A folder's JSON files as a package with fixed times (equal files give equal
    bytes), and the sum of each file."""
    out, sums = io.BytesIO(), {}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(Path(folder).glob("*.json")):
            body = file.read_bytes()
            sums[file.name] = hashlib.sha256(body).hexdigest()
            z.writestr(zipfile.ZipInfo(file.name), body)
    return out.getvalue(), sums


def update(url: str, folder: str, state_path: str, client: str, fetch: Fetch, signed: Callable[[bytes], bool], now: Callable[[], str]) -> bool:
    """One round of a poller: whether a newer package was installed.  Failures are
    counted in the state, and never raised."""
    state = load_state(state_path)
    try:
        manifest, etag = available(url, state, client, fetch)
        if manifest is None:
            save_state(state_path, State(state.version, etag, now(), state.updated_at))
            return False
        body, _ = fetch(manifest.url, "")
        install(body or b"", manifest, folder, signed)
    except Exception:  # noqa: BLE001  a poller goes on, whatever the feed gives
        save_state(state_path, State(state.version, state.etag, now(), state.updated_at, state.failures + 1))
        return False
    save_state(state_path, State(manifest.version, etag, now(), now()))
    return True
