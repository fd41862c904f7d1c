"""System descriptions in JSON: services, their images, repositories, databases and connections."""

from __future__ import annotations

import json

from .base import Extraction

_STORES = {"rds": "database", "dynamodb": "database", "cloudsql": "database", "sqs": "queue", "sns": "queue", "pubsub": "queue", "s3": "storage", "gcs": "storage", "r2": "storage"}


class SystemSpec:
    language = "systemspec"
    extensions = (".json",)

    def can_extract(self, path: str, text: str) -> bool:
        """An object with ``name`` and ``services`` at its root."""
        try:
            root = json.loads(text)
        except ValueError:
            return False
        return isinstance(root, dict) and bool(root.get("name")) and isinstance(root.get("services"), dict)

    def framework(self, path: str, text: str) -> str:
        return ""

    def extract(self, path: str, text: str) -> Extraction:
        root, out = json.loads(text), Extraction()
        at = {"source_file": path, "language": "systemspec"}
        system = out.node(f"system:{root['name']}", "system", root["name"], **at, doc=str(root.get("description") or ""))
        for name, spec in root["services"].items():
            spec = spec if isinstance(spec, dict) else {}
            own = out.node(f"svc:{name}", "service", name, **at, image=str(spec.get("image") or ""))
            out.edge(system, own, "contains")
            repo = spec.get("repo")
            url = repo.get("url") if isinstance(repo, dict) else repo
            if url:
                out.edge(own, f"repo:{url}", "links_to")
            links = spec.get("connections") or {}
            for target in links:
                to = target if isinstance(target, str) else target.get("to") or target.get("service") or ""
                if to:
                    out.edge(own, f"svc:{to}", "connects_to")
            for cloud in ("aws", "gcp", "cloudflare"):
                for kind, items in (spec.get(cloud) or {}).items():
                    for item in items if isinstance(items, list) else [items]:
                        label = item if isinstance(item, str) else item.get("name") or item.get("id") or kind
                        out.edge(own, out.node(f"{kind}:{label}", _STORES.get(kind, "unknown"), label, **at), "uses")
            for tool, prefix, kind in (("helm", "helm", "helm_chart"), ("terraform", "terraform", "terraform_module")):
                deploy = (spec.get("deployment") or {}).get(tool) or spec.get(tool)
                if deploy:
                    label = deploy if isinstance(deploy, str) else deploy.get("chart") or deploy.get("module") or deploy.get("name") or name
                    out.edge(out.node(f"{prefix}:{label}", kind, label, **at), own, "deploys" if tool == "helm" else "manages")
        return out
