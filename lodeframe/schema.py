"""Schemas of the code index. Natural keys stand for integer ids; every table has a session_id, by which it is partitioned."""

from __future__ import annotations

SCHEMA_VERSION = 2

_REFS = "refs array<array<string>>"
CLASS = f"descriptor string, access_flags int, super_descriptor string, interfaces array<string>, source_file string, fields array<struct<name:string,type_descriptor:string,access_flags:int,is_static:boolean>>, methods array<struct<name:string,params_descriptor:string,return_descriptor:string,access_flags:int,shorty:string,partial:boolean,regs:int,ins:int,units:int,strings:array<string>,refs:array<array<string>>>>, annotations array<struct<descriptor:string,visibility:int,args:string,method:string>>, constants array<string>"
DEX = "name string, origin string, size long, version string, sha string, counts map<string,long>"
COMPONENT = "struct<type:string,name:string,exported:boolean,permission:string,process:string,enabled:boolean>"
MANIFEST = f"package string, version_name string, version_code long, min_sdk int, target_sdk int, application string, uses_permissions array<string>, permissions array<string>, features array<string>, meta_data map<string,string>, components array<{COMPONENT}>"
LIB = "abi string, name string, size long, origin string"
RESOURCE = "pkg string, type string, name string, type_id int, entry_id int, id string"
FACTS = "origin string, services int, versions int, kotlin_modules int, signing_files int, coroutines boolean, resource_table boolean, assets array<string>, r_count int, r_sample array<string>, keep array<string>, headers int, notes array<string>"

#: What a parser row can be, and the shape of its payload.
PAYLOADS = {"class": CLASS, "dex": DEX, "manifest": MANIFEST, "lib": LIB, "resource": RESOURCE, "facts": FACTS, "notes": "notes array<string>"}
PARSED = "entity string, file_ord int, dex_idx int, ord int, source string, payload string"

TABLES = {
    "dex": ("dex_idx",),
    "classes": ("descriptor",),
    "methods": ("method_key",),
    "fields": ("class_descriptor", "name"),
    "strings": ("id",),
    "string_grams": ("gram", "id"),
    "string_refs": ("method_key", "value"),
    "refs_by_string": ("id", "method_key"),
    "xref_edges": ("caller_key", "kind", "callee_descriptor"),
    "edges_by_callee": ("callee_descriptor", "caller_key", "kind"),
    "annotations": ("class_descriptor", "method_key", "descriptor"),
    "manifest": (),
    "components": ("type", "name"),
    "native_libs": ("abi", "name"),
    "resource_entries": ("id",),
    "facts": ("origin",),
}

#: The stored columns of each table, beside session_id.
COLUMNS = {
    "dex": "dex_idx int, name string, origin string, size long, version string, source string, counts map<string,long>",
    "classes": "dex_idx int, descriptor string, simple_name string, package string, access_flags int, super_descriptor string, interfaces array<string>, source string, origin_file string, kind string, source_file string",
    "methods": "class_descriptor string, name string, params_descriptor string, return_descriptor string, method_key string, access_flags int, is_static boolean, is_constructor boolean, has_refs boolean, partial boolean, param_count int, shorty string, regs int, ins_size int, unit_count int",
    "fields": "class_descriptor string, name string, type_descriptor string, access_flags int, is_static boolean",
    "strings": "id long, value string, lc string, len int",
    "string_grams": "gram string, id long",
    "string_refs": "method_key string, value string",
    "refs_by_string": "id long, value string, method_key string",
    "xref_edges": "caller_key string, kind int, callee_descriptor string, callee_owner string, callee_name string, callee_params string, callee_ret string, hits long",
    "edges_by_callee": "caller_key string, kind int, callee_descriptor string, callee_owner string, callee_name string, callee_params string, callee_ret string, hits long",
    "annotations": "class_descriptor string, method_key string, descriptor string, visibility int, args string",
    "manifest": "package string, version_name string, version_code long, min_sdk int, target_sdk int, application string, uses_permissions array<string>, permissions array<string>, features array<string>, meta_data map<string,string>",
    "components": "type string, name string, exported boolean, permission string, process string, enabled boolean",
    "native_libs": "abi string, name string, size long, origin string",
    "resource_entries": RESOURCE,
    "facts": FACTS,
}

#: Tables that are clustered by their key over all files of a session, for probes by it, and the columns that get Bloom filters.
CLUSTERED = ("strings", "string_grams", "refs_by_string", "edges_by_callee")
BLOOM = {"classes": ("simple_name",), "methods": ("name",), "refs_by_string": ("id",), "edges_by_callee": ("callee_descriptor", "callee_name")}
#: A second level of folders below a session's.
PARTED = {"string_grams": "part"}
