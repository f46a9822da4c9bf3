"""Which archives hold the API of a JDK release: release stubs (ct.sym) for older ones, module files for the installed one."""

from __future__ import annotations

import os
import re
import zipfile
from glob import glob

from .jars import release_code, stub_entry

# Checked in this order; the first names a JDK home or a ct.sym file.
PINS = ("LINKORA_JDK", "JAVA_HOME")


def home() -> str | None:
    return next((os.environ[v] for v in PINS if os.environ.get(v)), None)


def stubs_of(place: str) -> str | None:
    if os.path.isfile(place):
        return place
    path = os.path.join(place, "lib", "ct.sym")
    return path if os.path.isfile(path) else None


def installed_release(place: str) -> int | None:
    """The feature release of a JDK home, from its `release` file."""
    try:
        with open(os.path.join(place, "release"), encoding="utf-8") as f:
            m = re.search(r'^JAVA_VERSION="?(?:1\.)?(\d+)', f.read(), re.M)
    except OSError:
        return None
    return int(m[1]) if m else None


def releases(ct_sym: str) -> list[int]:
    """The releases that an archive of stubs holds."""
    with zipfile.ZipFile(ct_sym) as z:
        codes = {c for name in z.namelist() if (stub := stub_entry(name)) for c in stub[0]}
    return sorted(int(c, 36) for c in codes if int(c, 36) >= 8)


def stubs(release: int) -> str:
    """The ct.sym archive for a layer of one release. Raises ValueError where there is none or it lacks the release."""
    release_code(release)
    place = home()
    path = stubs_of(place) if place else None
    if path is None:
        raise ValueError(f"release {release} needs a JDK: set {PINS[0]} to a JDK home or a ct.sym file, or {PINS[1]} to a JDK home")
    if release not in (known := releases(path)):
        raise ValueError(f"{path} has no release {release}, only {', '.join(map(str, known)) or 'none'}; the JDK's own release is not in it")
    return path


def whole_release(release: int) -> tuple[list[str], int | None]:
    """(archives, release to select in them) of the whole API of a release: the module files of an installed one, else its stubs."""
    place = home()
    if place is None:
        raise ValueError(f"a comparison of JDK releases needs {PINS[0]} or {PINS[1]}")
    if installed_release(place) == release:
        found = sorted(glob(os.path.join(glob_safe(place), "jmods", "*.jmod")))
        if not found:
            raise ValueError(f"release {release} is the JDK's own and has no stubs, and {place} has no jmods")
        return found, None
    return [stubs(release)], release


def glob_safe(path: str) -> str:
    return re.sub(r"([*?[])", r"[\1]", path)
