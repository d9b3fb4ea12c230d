"""Collector of the entities of one file, as rows (kind, id, ordinal, payload)."""

from __future__ import annotations

import json


class Records:
    def __init__(self, path: str):
        self.path = path
        self.rows: list[tuple[str, int, dict]] = []
        self._ids: set[tuple[str, str]] = set()

    def _add(self, kind: str, **payload: object) -> None:
        self.rows.append((kind, len(self.rows), payload))

    def id(self, *parts: str) -> str:
        return ":".join(p for p in (self.path, *parts) if p)

    def klass(self, name, local, docstring, start, end, is_abstract, decorators, bases, interfaces, kind) -> str:
        cid = self.id(local)
        self._add("Class", id=cid, name=name, docstring=docstring, start_line=start, end_line=end, is_abstract=bool(is_abstract), decorators=decorators, base_classes=bases, interfaces=interfaces, language_type=kind)
        self._add("Edge", rel_type="DEFINES_CLASS", src_id=self.path, dst_id=cid)
        return cid

    def interface(self, name, local, docstring, methods) -> str:
        iid = self.id(local)
        self._add("Interface", id=iid, name=name, docstring=docstring, methods=methods)
        self._add("Edge", rel_type="DEFINES_INTERFACE", src_id=self.path, dst_id=iid)
        return iid

    def function(self, name, owner, signature, docstring, start, end, *, is_async=False, is_static=False, returns=None, complexity=1, params=(), visibility="public") -> str:
        fid = f"{owner}:{name}" if owner else self.id(name)
        self._add(
            "Function", id=fid, name=name, class_id=owner, signature=signature, docstring=docstring, start_line=start, end_line=end, is_async=is_async, is_static=is_static, is_method=owner is not None,
            return_type=returns, complexity=complexity, parameters=json.dumps(list(params)), visibility=visibility,
        )
        if owner:
            self._add("Edge", rel_type="HAS_METHOD", src_id=owner, dst_id=fid, visibility=visibility)
        else:
            self._add("Edge", rel_type="DEFINES_FUNCTION", src_id=self.path, dst_id=fid)
        return fid

    def variable(self, name, owner, var_type, scope, is_constant, visibility=None) -> None:
        vid = f"{owner}:{name}" if owner else self.id(name)
        self._add("Variable", id=vid, name=name, var_type=var_type, scope=scope, is_constant=bool(is_constant))
        if owner:
            self._add("Edge", rel_type="HAS_VARIABLE", src_id=owner, dst_id=vid, visibility=visibility)

    def imported(self, local, name, source, is_external, symbols) -> None:
        iid = self.id(local)
        if ("Import", iid) not in self._ids:
            self._ids.add(("Import", iid))
            self._add("Import", id=iid, name=name, source=source, is_external=is_external, symbols=symbols)
            self._add("Edge", rel_type="IMPORTS", src_id=self.path, dst_id=iid)

    def call(self, function, name, line) -> None:
        self._add("Call", src_id=function, name=name, line=line)

    def use(self, function, name) -> None:
        self._add("Use", src_id=function, name=name)

    def detect(self, src, dst, rel, confidence, method, line) -> None:
        local = src.removeprefix(self.path + ":").replace(":", "::")
        self._add("Detected", src_name=local, dst_name=dst, rel_type=rel, confidence=confidence, detection_method=method, context=None, line=line)
