"""Column functions of the engine."""

from .chains import canonical_chain, chain_is_descendant, chain_parts, chain_suffix, strip_bind, strip_this
from .constants import js_add, js_object_merge, js_template, property_key
from .modules import glob_to_regex, is_internal_request, normalize_path, package_root
from .network import private_ipv4_or_localhost, private_ipv6
from .ranks import confidence_meets, severity_rank

__all__ = [
    "canonical_chain", "chain_is_descendant", "chain_parts", "chain_suffix", "confidence_meets", "glob_to_regex", "is_internal_request", "js_add", "js_object_merge",
    "js_template", "normalize_path", "package_root", "private_ipv4_or_localhost", "private_ipv6", "property_key", "severity_rank", "strip_bind", "strip_this",
]
