"""Repository-URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted URL shapes (group 1 owner, group 2 repository).
GITHUB_URL = r"^https?://github\.com/([^/]+)/([^/]+?)(?:\.git)?(?:/.*)?$"
HTTPS_REMOTE = r"url\s*=\s*https://[^/]+/([^/]+)/([^/\s]+?)(?:\.git)?(?:\s|$)"
SSH_REMOTE = r"url\s*=\s*git@[^:]+:([^/]+)/([^/\s]+?)(?:\.git)?(?:\s|$)"


def is_github(url: Column) -> Column:
    return url.startswith("https://github.com/") | url.startswith("http://github.com/")


def owner_repo(url: Column) -> Column:
    """struct(owner, repo) of a GitHub URL, '.git' and deeper paths cut; NULL otherwise."""
    return F.when(
        url.rlike(GITHUB_URL),
        F.struct(F.regexp_extract(url, GITHUB_URL, 1).alias("owner"), F.regexp_extract(url, GITHUB_URL, 2).alias("repo")),
    )


def owner_of_remote(config_text: Column) -> Column:
    """Owner named by a git config: https remote first, then ssh, else 'local'."""
    return (
        F.when(config_text.rlike(HTTPS_REMOTE), F.regexp_extract(config_text, HTTPS_REMOTE, 1))
        .when(config_text.rlike(SSH_REMOTE), F.regexp_extract(config_text, SSH_REMOTE, 1))
        .otherwise("local")
    )
