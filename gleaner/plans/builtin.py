"""The rules that are there without any file."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from .model import And, Leaf, Rule, RuleSet, ScanParams, load_ruleset, merge

_C = "critical"


def _content(name: str, severity: str, pattern: str, case_sensitive: bool = False) -> Rule:
    return Rule(name, Leaf("content", "regex", pattern, case_sensitive), severity)


#: Names, severities and expressions of the catalogue.
RULES = (
    _content("P0101-私钥文件头", _C, r"-----BEGIN\s+(RSA\s+|EC\s+|DSA\s+|OPENSSH\s+|PGP\s+)?PRIVATE\s+KEY-----"),
    _content("P0102-通用密码赋值", "warning", r"(?i)(password|passwd|pwd)\s*[=:]\s*\S+"),
    Rule("P0103-敏感配置文件名", Leaf("filename", "regex", r"(?i)(^\.env$|^\.env\.|^credentials|^secrets\.|\.pem$|\.key$|\.pfx$|\.keystore$)"), "info"),
    Rule("P0104-邮件信息包含敏感词", And((Leaf("filename", "regex", r"(?i)(^\.eml$)"), Leaf("content", "regex", "(价格|内部|商业|薪酬)"))), _C),
    _content("P0201-AWS-Access-Key-ID", _C, r"\b(AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{16}\b"),
    _content("P0202-AWS-Secret-Access-Key", _C, r"(?i)aws_secret_access_key\s*[=:]\s*[A-Za-z0-9/+=]{40}"),
    _content("P0203-GitHub-Token", _C, r"\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b|\bgithub_pat_[A-Za-z0-9_]{82,}\b"),
    _content("P0204-Slack-Token", _C, r"\bxox[abpr]-[A-Za-z0-9-]{10,72}\b"),
    _content("P0205-JWT", "warning", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    _content("P0206-Stripe-Key", _C, r"\b(sk|rk)_(live|test)_[A-Za-z0-9]{24,}\b"),
    _content("P0207-GCP-API-Key", "warning", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    _content("P0208-Azure-SAS-Token", _C, r"(?i)sig=[A-Za-z0-9%+/=]{20,}.*(sv=|st=|se=|sr=|sp=)"),
    _content("P0209-Azure-Connection-String", _C, r"(?i)accountkey=[A-Za-z0-9+/=]{50,}"),
    _content("P0210-Generic-API-Key", "warning", r"(?i)(api[_-]?key|access[_-]?token|auth[_-]?token)\s*[=:]\s*[A-Za-z0-9_\-./+=]{20,}|bearer\s+[A-Za-z0-9_\-./+=]{20,}"),
)


#: What is scanned, and how, unless a rule file says otherwise.
EXTENSIONS = tuple("txt log pdf docx pptx xlsx xlsm ods odt wps et dps eml xls doc ppt zip rar".split())
PARAMS = ScanParams(max_workers=5, max_file_size=50 * 1024 * 1024, scan_archives=True, use_cache=True, perf=False)


def builtin_ruleset() -> RuleSet:
    return RuleSet(rules=RULES, scan_extensions=EXTENSIONS, scan_params=PARAMS)


def load_with_builtin(paths: Iterable[str], builtin: bool = True) -> RuleSet:
    """The rules that are there without any file (unless builtin is false), then each file's on top, in order."""
    return reduce(merge, (load_ruleset(p) for p in paths), builtin_ruleset() if builtin else RuleSet())
