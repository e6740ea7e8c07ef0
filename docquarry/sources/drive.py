"""A remote drive of a site: listing, filtering, downloading; and as a Spark data source.

The client speaks the drive interface of a site over HTTP (children pages with
`@odata.nextLink`, `folder` and `file` facets, custom columns under `listItem.fields`). The
function that sends requests can be replaced, so that all of it can be tested without a network.
"""

from __future__ import annotations

import fnmatch
import json
from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any
from urllib.error import HTTPError, URLError
from urllib.parse import quote, urlencode, urlsplit
from urllib.request import Request, urlopen

LOGIN = "https://login.microsoftonline.com/{tenant}/oauth2/v2.0/token"
API = "https://graph.microsoft.com/v1.0"
_EXPAND = "?$expand=listItem($expand=fields)"

#: Columns of every list; what else there is was made by the site's users.
BUILT_IN = frozenset(
    """id ContentType Created Modified AuthorLookupId EditorLookupId Attachments Edit LinkFilename LinkFilenameNoMenu DocIcon Title
    ItemChildCount FolderChildCount FileLeafRef FileDirRef FileRef LinkTitle LinkTitleNoMenu SharedWithUsersId SharedWithDetails
    Restricted FileSizeDisplay ParentVersionStringLookupId ParentLeafNameLookupId CheckoutUserLookupId CheckedOutUserId
    IsCheckedoutToLocal TemplateUrl xd_ProgID xd_Signature Order GUID WorkflowVersion WorkflowInstanceID AccessPolicy BSN
    HTML_x0020_File_x0020_Type MetaInfo ProgId ScopeId A2ODMountCount SyncClientId""".split()
) | {f"_{n}" for n in "UIVersionString ComplianceFlags ComplianceTag ComplianceTagWrittenTime ComplianceTagUserId CommentCount LikeCount DisplayName CheckinComment IsRecord VirusStatus VirusVendorID VirusInfo ExtendedDescription CopySource HasCopyDestinations SourceUrl SharedFileIndex Level ShortcutUrl ShortcutSiteId ShortcutWebId ShortcutUniqueId".split()}

SCHEMA = "name string, id string, web_url string, download_url string, size bigint, mime_type string, last_modified string, created string, parent_path string, custom_fields map<string,string>"


class DriveError(Exception):
    pass


class DriveAuthError(DriveError):
    pass


class DriveRequestError(DriveError):
    def __init__(self, message: str, status: int | None = None, body: str | None = None, url: str | None = None):
        super().__init__(message)
        self.status, self.body, self.url = status, body, url


@dataclass(frozen=True)
class AppCredentials:
    tenant_id: str
    client_id: str
    client_secret: str = field(repr=False)
    scope: str = "https://graph.microsoft.com/.default"


class DriveFile(namedtuple("DriveFile", [f.split()[0] for f in SCHEMA.split(", ")], defaults=["", *[None] * 7])):
    """A row of the listing; times are texts as the drive gives them."""

    @property
    def full_path(self) -> str:
        return "/".join(filter(None, (self.parent_path, self.name)))


def parse_iso(text: str | None) -> datetime | None:
    """To the second; without a zone it's UTC; None if it can't be read."""
    try:
        when = datetime.fromisoformat((text or "").replace("Z", "+00:00")).replace(microsecond=0)
    except ValueError:
        return None
    return when if when.tzinfo else when.replace(tzinfo=timezone.utc)


Bounds = tuple["datetime | None", "datetime | None"]


@dataclass(frozen=True)
class DriveFilter:
    """Half-open bounds of times; the suffixes and shell patterns of which one must fit."""

    created: Bounds = (None, None)
    modified: Bounds = (None, None)
    folder_paths: tuple[str, ...] = ()
    path_patterns: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()

    def matches(self, file: DriveFile) -> bool:
        for text, (low, high) in ((file.created, self.created), (file.last_modified, self.modified)):
            if low or high:
                when = parse_iso(text)
                if when is None or low and when < low or high and when >= high:
                    return False
        if self.extensions and not file.name.lower().endswith(tuple(e.lower() for e in self.extensions)):
            return False
        return not self.path_patterns or any(fnmatch.fnmatch(file.full_path, p) for p in self.path_patterns)


class DriveClient:
    def __init__(self, site_url: str, credentials: AppCredentials, send: Callable[..., Any] = urlopen, timeout: float = 30.0):
        self._site_url, self._credentials = site_url.rstrip("/"), credentials
        self._send_request, self._timeout = send, timeout
        self._token: str | None = None
        self._site: str | None = None

    def _send(self, request: Request) -> bytes:
        url = request.full_url
        try:
            answer = self._send_request(request, timeout=self._timeout)
        except HTTPError as error:
            raise DriveRequestError(f"the request failed with status {error.code}", error.code, error.read().decode("utf-8", "replace"), url) from error
        except URLError as error:
            raise DriveRequestError(f"no connection: {error.reason}", url=url) from error
        try:
            status = getattr(answer, "status", None) or answer.getcode()
            body = answer.read()
        finally:
            if hasattr(answer, "close"):
                answer.close()
        if not 200 <= status < 300:
            raise DriveRequestError(f"the request gave status {status}", status, body.decode("utf-8", "replace"), url)
        return body

    def fetch_access_token(self) -> str:
        who = self._credentials
        form = urlencode({"grant_type": "client_credentials", "scope": who.scope, "client_id": who.client_id, "client_secret": who.client_secret})
        request = Request(LOGIN.format(tenant=who.tenant_id), form.encode(), {"Content-Type": "application/x-www-form-urlencoded"}, method="POST")
        try:
            token = json.loads(self._send(request)).get("access_token")
        except ValueError as error:
            raise DriveAuthError("the answer isn't JSON") from error
        if not token:
            raise DriveAuthError("the answer has no token")
        self._token = token
        return token

    def _get(self, url: str) -> bytes:
        token = self._token or self.fetch_access_token()
        return self._send(Request(url, headers={"Authorization": f"Bearer {token}", "Accept": "application/json"}))

    def _json(self, url: str) -> dict[str, Any]:
        body = self._get(url).decode("utf-8", "replace")
        try:
            return json.loads(body)
        except ValueError as error:
            raise DriveRequestError("the answer isn't JSON", body=body, url=url) from error

    def site_id(self) -> str:
        if self._site is None:
            parts = urlsplit(self._site_url)
            found = self._json(f"{API}/sites/{parts.hostname}:{quote(parts.path)}").get("id")
            if not found:
                raise DriveRequestError("the site has no id", url=self._site_url)
            self._site = found
        return self._site

    def _drive(self, drive_id: str | None) -> str:
        return f"{API}/sites/{self.site_id()}/" + ("drive" if drive_id is None else f"drives/{drive_id}")

    def drives(self) -> list[dict[str, Any]]:
        return self._json(f"{API}/sites/{self.site_id()}/drives").get("value", [])

    def _items(self, url: str | None) -> Iterator[dict[str, Any]]:
        while url:
            page = self._json(url)
            yield from (i for i in page.get("value", []) if isinstance(i, dict))
            url = page.get("@odata.nextLink")

    @staticmethod
    def _file(item: dict[str, Any], parent: str) -> DriveFile:
        fields = (item.get("listItem") or {}).get("fields") or {}
        custom = {k: v for k, v in fields.items() if k not in BUILT_IN and not k.startswith("@odata")}
        facet = item.get("file")
        return DriveFile(item.get("name", ""), item.get("id", ""), item.get("webUrl", ""), item.get("@microsoft.graph.downloadUrl"), item.get("size"), facet.get("mimeType") if isinstance(facet, dict) else None, item.get("lastModifiedDateTime"), item.get("createdDateTime"), parent or None, custom or None)

    def walk(self, folder_id: str | None = None, parent: str = "", drive_id: str | None = None) -> Iterator[DriveFile]:
        """Files below a folder; those of a folder before those of its folders."""
        where = "root" if folder_id is None else f"items/{folder_id}"
        folders = []
        for item in self._items(f"{self._drive(drive_id)}/{where}/children{_EXPAND}"):
            if "folder" in item:
                folders.append(item)
            elif "file" in item:
                yield self._file(item, parent)
        for item in folders:
            if item.get("id"):
                name = item.get("name", "")
                yield from self.walk(item["id"], f"{parent}/{name}" if parent else name, drive_id)

    def files(self, test: DriveFilter = DriveFilter(), drive_id: str | None = None) -> Iterator[DriveFile]:
        """Files that pass. Folders that were named are listed one after the other, those that
        don't exist are left out, and a file that two of them hold comes twice."""
        for path in test.folder_paths or ("",):
            start = None
            if path:
                try:
                    item = self._json(f"{self._drive(drive_id)}/root:/{quote(path.strip('/'))}")
                except DriveRequestError as error:
                    if error.status == 404:
                        continue
                    raise
                if "folder" not in item:
                    continue
                start = item.get("id")
            yield from filter(test.matches, self.walk(start, path, drive_id))

    def files_modified_since(self, since: datetime, **more: Any) -> Iterator[DriveFile]:
        return self.files(DriveFilter(modified=(since, None), **more))

    def files_created_since(self, since: datetime, **more: Any) -> Iterator[DriveFile]:
        return self.files(DriveFilter(created=(since, None), **more))

    def files_in_folder(self, path: str = "/", drive_id: str | None = None) -> list[DriveFile]:
        inner = path.strip("/")
        where = f"root:/{quote(inner, safe='')}:" if inner else "root"
        return [self._file(i, "") for i in self._items(f"{self._drive(drive_id)}/{where}/children{_EXPAND}") if "file" in i and "folder" not in i]

    def download(self, file_id: str, drive_id: str | None = None) -> bytes:
        return self._get(f"{self._drive(drive_id)}/items/{file_id}/content")

    def download_path(self, path: str, drive_id: str | None = None) -> bytes:
        return self._get(f"{self._drive(drive_id)}/root:/{quote(path.strip('/'))}:/content")


def _row(file: DriveFile) -> tuple:
    custom = None if file.custom_fields is None else {k: v if isinstance(v, str) else json.dumps(v) for k, v in file.custom_fields.items()}
    return (file.name, file.id, file.web_url, file.download_url, file.size, file.mime_type, file.last_modified, file.created, file.parent_path, custom)


def _client(options: dict[str, str]) -> DriveClient:
    import importlib

    credentials = AppCredentials(options.get("tenant_id", ""), options.get("client_id", ""), options.get("client_secret", ""))
    send = urlopen
    if options.get("sender"):
        module, _, name = options["sender"].rpartition(".")
        send = getattr(importlib.import_module(module), name)
    return DriveClient(options["site_url"], credentials, send)


def _filter(options: dict[str, str]) -> DriveFilter:
    listed = lambda key: tuple(x for x in options.get(key, "").split(";") if x)
    bounds = lambda what: (parse_iso(options.get(f"{what}_after")), parse_iso(options.get(f"{what}_before")))
    return DriveFilter(bounds("created"), bounds("modified"), listed("folder_paths"), listed("path_patterns"), listed("extensions"))


def _data_source():
    from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

    class Folder(InputPartition):
        def __init__(self, path: str, low: str = "", high: str = ""):
            super().__init__(path)
            self.path, self.low, self.high = path, low, high

    class Reader(DataSourceReader):
        """One partition for each folder named, or one for the drive."""

        def __init__(self, options: dict[str, str]):
            self.options = dict(options)

        def partitions(self) -> list[InputPartition]:
            return [Folder(p) for p in _filter(self.options).folder_paths or ("",)]

        def read(self, partition):
            options = self.options | {"folder_paths": partition.path}
            return map(_row, _client(options).files(_filter(options), options.get("drive_id")))

    class Stream(DataSourceStreamReader):
        """Files by their time of change: an offset is a time, and a batch has what changed
        from one to the next. A file that changes again comes again."""

        def __init__(self, options: dict[str, str]):
            self.options = dict(options)

        def initialOffset(self) -> dict:
            return {"time": self.options.get("modified_after") or "1970-01-01T00:00:00Z"}

        def latestOffset(self) -> dict:
            return {"time": self.options.get("modified_before") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [Folder(p, start["time"], end["time"]) for p in _filter(self.options).folder_paths or ("",)]

        def read(self, partition):
            options = self.options | {"folder_paths": partition.path, "modified_after": partition.low, "modified_before": partition.high}
            return map(_row, _client(options).files(_filter(options), options.get("drive_id")))

    class Drive(DataSource):
        @classmethod
        def name(cls) -> str:
            return "drive"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options)

        def streamReader(self, schema):
            return Stream(self.options)

    return Drive


def register(spark) -> None:
    """Make spark.read.format("drive") and spark.readStream.format("drive") known. Options:
    site_url, tenant_id, client_id, client_secret, drive_id, created_after, created_before,
    modified_after, modified_before, folder_paths, path_patterns, extensions (lists parted by
    ";"), and sender: the dotted name of a function to send requests with."""
    spark.dataSource.register(_data_source())


def with_content(listing, options: dict[str, str], id_col: str = "id"):
    """A listing with each file's bytes, downloaded in parallel where the rows are."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*listing.schema.fields, T.StructField("content", T.BinaryType())])

    def fetch(batches):
        client = _client(options)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                content = client.download(row.column(id_col)[0].as_py(), options.get("drive_id"))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], names=[*row.schema.names, "content"])

    return listing.mapInArrow(fetch, schema)
