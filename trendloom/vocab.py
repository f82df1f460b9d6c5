"""The technology vocabulary and its synonym dictionary.

FIXED VALUES — these must equal the product's vocabulary for identical
results: the keyword list (keyword, display_name, include_hiring, image_path)
and the synonym dictionary (token, canonical), as text, in their natural order.
The synonym text keeps its one repeated line ("postgresql postgresql").
"""

from __future__ import annotations

# ---- fixed values: keyword list (CSV with header) --------------------------
KEYWORDS_CSV = """\
keyword,display_name,include_hiring,image_path
python,Python,true,python.svg
javascript,JavaScript,true,javascript.svg
typescript,TypeScript,true,typescript.svg
java,Java,true,java.svg
cpp,C++,true,c++.svg
csharp,C#,true,csharp.svg
rust,Rust,true,rust.svg
php,PHP,true,php.svg
kotlin,Kotlin,true,kotlin.svg
dart,Dart,true,dart.svg
swift,Swift,true,swift.svg
ruby,Ruby,true,ruby.svg
scala,Scala,true,scala.svg
julia,Julia,true,julia.svg
elixir,Elixir,true,elixir.svg
erlang,Erlang,true,erlang.svg
clojure,Clojure,true,clojure.svg
perl,Perl,true,perl.svg
fsharp,F#,true,fsharp.svg
zig,Zig,true,zig.svg
nim,Nim,true,nim.svg
ocaml,OCaml,true,ocaml.svg
haskell,Haskell,true,haskell.svg
fortran,Fortran,true,fortran.svg
postgresql,PostgreSQL,true,postgresql.svg
mysql,MySQL,true,mysql.svg
redis,Redis,true,redis.svg
kafka,Kafka,true,kafka.svg
docker,Docker,true,docker.svg
kubernetes,Kubernetes,true,kubernetes.svg
terraform,Terraform,true,terraform.svg
mongodb,MongoDB,true,mongodb.svg
sqlite,SQLite,true,sqlite.svg
elasticsearch,Elasticsearch,true,elasticsearch.svg
mariadb,MariaDB,true,mariadb.svg
neo4j,Neo4j,true,neo4j.svg
chatgpt,ChatGPT,false,chatgpt.svg
bitcoin,Bitcoin,false,bitcoin.svg
clickhouse,Clickhouse,true,clickhouse.svg
duckdb,DuckDB,true,duckdb.svg
"""

# ---- fixed values: synonym dictionary (token, canonical) -------------------
SYNONYMS_TEXT = """\
python          python
python2         python
python3         python
py              python
javascript      javascript
typescript      typescript
java            java
java8           java
cpp             cpp
csharp          csharp
rust            rust
php             php
kotlin          kotlin
dart            dart
swift           swift
ruby            ruby
scala           scala
scala2          scala
scala3          scala
julia           julia
elixir          elixir
erlang          erlang
clojure         clojure
clj             clojure
perl            perl
fsharp          fsharp
zig             zig
nim             nim
ocaml           ocaml
haskell         haskell
fortran         fortran
postgresql      postgresql
postgres        postgresql
postgresql      postgresql
mysql           mysql
redis           redis
kafka           kafka
docker          docker
kubernetes      kubernetes
k8s             kubernetes
terraform       terraform
mongodb         mongodb
sqlite          sqlite
elasticsearch   elasticsearch
mariadb         mariadb
neo4j           neo4j
chatgpt         chatgpt
bitcoin         bitcoin
btc             bitcoin
clickhouse      clickhouse
duckdb          duckdb
"""
