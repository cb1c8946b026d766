"""The whole scan: files and history, filters, baseline."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from credsieve.operators import filters, history, scan, verify
from credsieve.operators.baseline import suppress
from credsieve.operators.similarity import THRESHOLD
from credsieve.session import settled
from credsieve.sources.config import Config
from credsieve.sources.files import prune, resolve_max_file_size


def complete_scan(
    files: DataFrame,
    *,
    config: Config | None = None,
    max_file_size: int | None = None,
    include_globs: Sequence[str] = (),
    exclude_globs: Sequence[str] = (),
    include_extensions: Sequence[str] = (),
    commits: DataFrame | None = None,
    diffs: DataFrame | None = None,
    max_commits: int = 0,
    since: str | None = None,
    reachable: str | None = None,
    baseline: DataFrame | None = None,
    verifier: Callable[[DataFrame], DataFrame] | None = None,
    store: DataFrame | None = None,
    threshold: float = THRESHOLD,
    long_lines: str = "keep",
    base_paths: bool = False,
    judged_to: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Findings, with their ``origin``, that survive config and baseline.

    ``files`` has ``path``, ``size`` and ``content``; without ``commits`` and ``diffs``
    history is left out.  Without ``verifier`` findings stay unverified, and a ``store``
    is refused because nothing would use it.  ``base_paths`` makes path allowlists apply to
    history findings as they do to files.  ``judged_to`` sees the judged file findings
    and returns them settled; ``scan_and_store`` uses it.
    """
    if store is not None and verifier is None:
        raise ValueError("a store needs a verifier")
    config = config or Config()
    rules = config.rule_set()
    kept = prune(
        files,
        max_file_size=resolve_max_file_size(max_file_size, config.size_cap),
        include_globs=include_globs,
        exclude_globs=[*exclude_globs, *config.allowlist.paths],
        include_extensions=include_extensions,
    )
    if verifier:
        coded = verify.scan_with_code(kept, rules, long_lines=long_lines)
        judged = verify.verify(coded, store=store, verifier=verifier, threshold=threshold)
        judged = judged_to(judged) if judged_to else judged
        found = judged.select(*scan.FINDING_COLUMNS)
    else:
        found = scan.scan_files(kept, rules, long_lines=long_lines)
    past = found.where("false")
    if commits is not None and diffs is not None:
        past = history.scan_history(
            commits, diffs, rules, max_commits=max_commits, since=since, reachable=reachable,
            long_lines=long_lines,
        )
    path = filters.BASE_PATH if base_paths else "file_path"
    found = filters.apply_config(history.all_findings(found, past), config, rules, path=path)
    return found if baseline is None else suppress(found, baseline)


def scan_and_store(
    files: DataFrame,
    store: DataFrame,
    *,
    verifier: Callable[[DataFrame], DataFrame] = verify.heuristic_verdicts,
    ephemeral: bool = False,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(findings, grown store) of a complete scan that reuses the store's verdicts.

    Findings judged anew join the store, reused ones do not; the judged findings are
    computed once for both results.
    """
    kept: list[DataFrame] = []

    def keep(judged: DataFrame) -> DataFrame:
        kept.append(settled(verify.without_vectors(judged, ephemeral=ephemeral), small=True))
        return kept[0]

    found = complete_scan(files, store=store, verifier=verifier, judged_to=keep, **options)
    return found, verify.grown_store(store, kept[0], ephemeral=ephemeral)
