"""Explicit schemas of every stored shape. Nothing is inferred."""

from pyspark.sql.types import StructType

BOX = "struct<x:double,y:double,w:double,h:double>"

RUNS = (
    f"doc_id string, page int, run_no int, text string, lead boolean, trail boolean, box {BOX}, "
    "base double, size double, bold boolean, italic boolean, font string"
)
LINES = (
    f"doc_id string, page int, line_no int, text string, box {BOX}, size double, bold boolean, "
    "italic boolean, font string, href string"
)
PICTURES = f"doc_id string, page int, pic_no int, box {BOX}, path string, px_w int, px_h int"
LINKS = f"doc_id string, page int, link_no int, box {BOX}, url string"
PAGES = "doc_id string, page int, width double, height double"
BLOCKS = (
    f"doc_id string, page int, ord int, block_id string, kind string, box {BOX}, lines array<int>, "
    "text string, role string, level int, depth int, bold boolean, italic boolean, marker string, "
    "size double, font string, picture int, href string"
)

_LINE = f"struct<text:string,box:{BOX},size:double,bold:boolean,italic:boolean,font:string,href:string>"
_RUN = (
    f"struct<text:string,lead:boolean,trail:boolean,box:{BOX},base:double,size:double,bold:boolean,"
    "italic:boolean,font:string>"
)
_PICTURE = f"struct<box:{BOX},path:string,px:array<int>>"
_LINK = f"struct<box:{BOX},url:string>"
_BLOCK = (
    f"struct<id:string,kind:string,page:int,box:{BOX},lines:array<int>,text:string,role:string,level:int,"
    "depth:int,bold:boolean,italic:boolean,marker:string,size:double,font:string,picture:int,href:string>"
)
LAYOUT_FILE = (
    "doc_id string, format int, reader int, bodySize double, "
    f"pages array<struct<n:int,width:double,height:double,runs:array<{_RUN}>,lines:array<{_LINE}>,"
    f"pictures:array<{_PICTURE}>,links:array<{_LINK}>,blocks:array<{_BLOCK}>>>"
)

_STEP_FIELDS = (
    "blocks:map<string,string>,joins:map<string,string>,cuts:map<string,string>,inserts:string,"
    "page_numbers:string,headers_footers:string,repeated_lines:map<string,string>"
)
EDITS = (
    "version string, blocks map<string,string>, joins map<string,string>, cuts map<string,string>, "
    "inserts string, done string, page_numbers string, headers_footers string, "
    "repeated_lines map<string,string>, undo array<string>, redo array<string>"
)
MANIFEST = "format string, name string, documents map<string,string>"

TESTS = (
    "id string, pdf string, page int, type string, category string, max_diffs int, text string, "
    "before string, after string, cell string, up string, down string, left string, right string, "
    "top_heading string, left_heading string, math string"
)
GROUND_TRUTH = (
    "page_info struct<image_path:string,page_attribute:struct<data_source:string>>, "
    "layout_dets array<struct<category_type:string,ignore:boolean,text:string>>"
)
_SCORE = (
    "struct<inputs:int,score:double,tests:int,categories:map<string,struct<passed:int,total:int>>,"
    "measures:map<string,double>,refused:int>"
)
HISTORY = (
    "date timestamp, benchmark string, revision string, label string, scorer string, tool string, "
    "made map<string,string>, commit string, pages int, pages_per_second double, browsers int, "
    f"unread int, markdown string, `all` {_SCORE}, text_layer {_SCORE}, "
    "coverage struct<`all`:double,text_layer:double>"
)


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
