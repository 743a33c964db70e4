"""Fixed dimensions of the catalogue. Callers may pass their own DataFrames of the same shape instead (X-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Product slug -> category.
PRODUCT_CATEGORIES = {
    "php": "Lenguaje / Runtime",
    "python": "Lenguaje / Runtime",
    "nodejs": "Lenguaje / Runtime",
    "ruby": "Lenguaje / Runtime",
    "go": "Lenguaje / Runtime",
    "perl": "Lenguaje / Runtime",
    "rust": "Lenguaje / Runtime",
    "elixir": "Lenguaje / Runtime",
    "dotnet": "Lenguaje / Runtime",
    "dotnetfx": "Lenguaje / Runtime",
    "bun": "Lenguaje / Runtime",
    "deno": "Lenguaje / Runtime",
    "nginx": "Servidor web / Proxy",
    "apache": "Servidor web / Proxy",
    "tomcat": "Servidor de aplicaciones",
    "eclipse-jetty": "Servidor de aplicaciones",
    "caddy": "Servidor web / Proxy",
    "haproxy": "Servidor web / Proxy",
    "varnish": "Cache / Proxy",
    "traefik": "Servidor web / Proxy",
    "envoy": "Servidor web / Proxy",
    "mysql": "Base de datos",
    "mariadb": "Base de datos",
    "postgresql": "Base de datos",
    "mongodb": "Base de datos",
    "redis": "Base de datos / Cache",
    "valkey": "Base de datos / Cache",
    "elasticsearch": "Base de datos / Búsqueda",
    "opensearch": "Base de datos / Búsqueda",
    "sqlite": "Base de datos",
    "cassandra": "Base de datos",
    "couchdb": "Base de datos",
    "laravel": "Framework backend (PHP)",
    "symfony": "Framework backend (PHP)",
    "cakephp": "Framework backend (PHP)",
    "codeigniter": "Framework backend (PHP)",
    "drupal": "CMS",
    "joomla": "CMS",
    "wordpress": "CMS",
    "typo3": "CMS",
    "magento": "E-commerce",
    "moodle": "Plataforma",
    "composer": "Gestor de dependencias",
    "django": "Framework backend (Python)",
    "rails": "Framework backend (Ruby)",
    "spring-framework": "Framework backend (Java)",
    "spring-boot": "Framework backend (Java)",
    "angular": "Framework frontend (JS)",
    "angularjs": "Framework frontend (JS)",
    "vue": "Framework frontend (JS)",
    "nuxt": "Framework frontend (JS)",
    "nextjs": "Framework frontend (JS)",
    "ember": "Framework frontend (JS)",
    "bootstrap": "Framework CSS",
    "docker-engine": "Infra / Contenedores",
    "kubernetes": "Infra / Contenedores",
}
# Product slug -> advisory ecosystem and package.
ADVISORY_PACKAGES = {
    "laravel": ("Packagist", "laravel/framework"),
    "symfony": ("Packagist", "symfony/symfony"),
    "cakephp": ("Packagist", "cakephp/cakephp"),
    "drupal": ("Packagist", "drupal/core"),
    "typo3": ("Packagist", "typo3/cms-core"),
    "composer": ("Packagist", "composer/composer"),
    "django": ("PyPI", "django"),
    "rails": ("RubyGems", "rails"),
    "angular": ("npm", "@angular/core"),
    "angularjs": ("npm", "angular"),
    "vue": ("npm", "vue"),
    "nextjs": ("npm", "next"),
    "nuxt": ("npm", "nuxt"),
    "ember": ("npm", "ember-source"),
    "bootstrap": ("npm", "bootstrap"),
    "spring-framework": ("Maven", "org.springframework:spring-core"),
    "spring-boot": ("Maven", "org.springframework.boot:spring-boot"),
    "wordpress": ("Packagist", "roots/wordpress"),
}
# Display order of the categories.
CATEGORY_ORDER = (
    "Lenguaje / Runtime",
    "Framework backend (PHP)",
    "Framework backend (Python)",
    "Framework backend (Ruby)",
    "Framework backend (Java)",
    "Framework frontend (JS)",
    "Framework CSS",
    "Librería JavaScript",
    "Utilidades JS",
    "Gráficos JavaScript",
    "Animación JS",
    "UI / Componentes",
    "Iconos / Tipografía",
    "Mapas / Geo",
    "Backend / SDK",
    "Auth / Seguridad",
    "Datos / Identidad (CL)",
    "CMS",
    "E-commerce",
    "Plataforma",
    "Servidor web / Proxy",
    "Servidor de aplicaciones",
    "Cache / Proxy",
    "Base de datos",
    "Base de datos / Cache",
    "Base de datos / Búsqueda",
    "Gestor de dependencias",
    "Infra / Contenedores",
    "otros",
)
# Registry package -> display name and category.
NPM_LIBRARIES = {
    "jquery": ("jQuery", "Librería JavaScript"),
    "jquery-ui": ("jQuery UI", "Librería JavaScript"),
    "moment": ("Moment.js", "Librería JavaScript"),
    "rxjs": ("RxJS", "Librería JavaScript"),
    "zone.js": ("Zone.js", "Librería JavaScript"),
    "axios": ("Axios", "Librería JavaScript"),
    "react": ("React", "Framework frontend (JS)"),
    "svelte": ("Svelte", "Framework frontend (JS)"),
    "alpinejs": ("Alpine.js", "Framework frontend (JS)"),
    "lodash": ("Lodash", "Utilidades JS"),
    "underscore": ("Underscore.js", "Utilidades JS"),
    "marked": ("Marked", "Utilidades JS"),
    "dayjs": ("Day.js", "Utilidades JS"),
    "core-js": ("core-js", "Utilidades JS"),
    "d3": ("D3.js", "Gráficos JavaScript"),
    "three": ("Three.js", "Gráficos JavaScript"),
    "plotly.js": ("Plotly", "Gráficos JavaScript"),
    "chart.js": ("Chart.js", "Gráficos JavaScript"),
    "paper": ("Paper.js", "Gráficos JavaScript"),
    "echarts": ("ECharts", "Gráficos JavaScript"),
    "gsap": ("GSAP", "Animación JS"),
    "sweetalert2": ("SweetAlert2", "UI / Componentes"),
    "swiper": ("Swiper", "UI / Componentes"),
    "owl.carousel": ("OWL Carousel", "UI / Componentes"),
    "@fancyapps/ui": ("FancyBox", "UI / Componentes"),
    "@popperjs/core": ("Popper.js", "UI / Componentes"),
    "datatables.net": ("DataTables", "UI / Componentes"),
    "select2": ("Select2", "UI / Componentes"),
    "@ng-bootstrap/ng-bootstrap": ("ng-bootstrap", "UI / Componentes"),
    "@ng-select/ng-select": ("ng-select", "UI / Componentes"),
    "angular-datatables": ("Angular DataTables", "UI / Componentes"),
    "primeng": ("PrimeNG", "UI / Componentes"),
    "bootstrap-icons": ("Bootstrap Icons", "Iconos / Tipografía"),
    "@fortawesome/fontawesome-free": ("Font Awesome", "Iconos / Tipografía"),
    "@turf/turf": ("Turf.js", "Mapas / Geo"),
    "@maptiler/sdk": ("MapTiler SDK", "Mapas / Geo"),
    "leaflet": ("Leaflet", "Mapas / Geo"),
    "maplibre-gl": ("MapLibre GL", "Mapas / Geo"),
    "mapbox-gl": ("Mapbox GL", "Mapas / Geo"),
    "material-design-lite": ("Material Design Lite", "Framework CSS"),
    "tailwindcss": ("Tailwind CSS", "Framework CSS"),
    "firebase": ("Firebase", "Backend / SDK"),
    "@auth0/angular-jwt": ("Auth0 Angular JWT", "Auth / Seguridad"),
    "@angular/cdk": ("Angular CDK", "UI / Componentes"),
    "@angular/material": ("Angular Material", "UI / Componentes"),
    "@fortawesome/angular-fontawesome": ("Font Awesome (Angular)", "Iconos / Tipografía"),
    "datatables.net-bs5": ("DataTables (Bootstrap 5)", "UI / Componentes"),
    "tslib": ("tslib", "Utilidades JS"),
    "include-media": ("include-media", "Framework CSS"),
    "chilean-rutify": ("Chilean Rutify (validador RUT)", "Datos / Identidad (CL)"),
}
# Android API level -> version, name, year, state.
ANDROID_API = {
    37: ("17", "Cinnamon Bun", 2026, "beta"),
    36: ("16", "Baklava", 2025, "estable"),
    35: ("15", "Vanilla Ice Cream", 2024, "estable"),
    34: ("14", "Upside Down Cake", 2023, "estable"),
    33: ("13", "Tiramisu", 2022, "estable"),
    32: ("12L", "Snow Cone v2", 2022, "antigua"),
    31: ("12", "Snow Cone", 2021, "antigua"),
    30: ("11", "Red Velvet Cake", 2020, "antigua"),
    29: ("10", "Quince Tart", 2019, "obsoleta"),
    28: ("9", "Pie", 2018, "obsoleta"),
    27: ("8.1", "Oreo", 2017, "obsoleta"),
    26: ("8.0", "Oreo", 2017, "obsoleta"),
    25: ("7.1", "Nougat", 2016, "obsoleta"),
    24: ("7.0", "Nougat", 2016, "obsoleta"),
    23: ("6.0", "Marshmallow", 2015, "obsoleta"),
    22: ("5.1", "Lollipop", 2015, "obsoleta"),
    21: ("5.0", "Lollipop", 2014, "obsoleta"),
}


def product_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRODUCT_CATEGORIES.items()), "slug string, category string")


def advisory_packages(spark: SparkSession) -> DataFrame:
    rows = [(slug, *pair) for slug, pair in ADVISORY_PACKAGES.items()]
    return spark.createDataFrame(rows, "slug string, ecosystem string, package string")


def npm_libraries(spark: SparkSession) -> DataFrame:
    rows = [(package, *pair) for package, pair in NPM_LIBRARIES.items()]
    return spark.createDataFrame(rows, "slug string, display_name string, category string")


def android_api(spark: SparkSession) -> DataFrame:
    rows = [(level, *facts) for level, facts in ANDROID_API.items()]
    return spark.createDataFrame(rows, "api int, version string, codename string, year int, state string")
