"""Known licences by the digest of their canonical form (see ``license_scan.canonical``)."""

from __future__ import annotations

# Licence, length and SHA-256 of the canonical form of whole texts, with and without their appendices.
DIGESTS: list[tuple[str, int, str]] = [
    ("Apache-2.0", 8842, "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Apache-2.0", 8870, "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Apache-2.0", 9886, "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", 9926, "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    ("Artistic-1.0-Perl", 5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-2-Clause", 1192, "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2"),
    ("BSD-3-Clause", 1371, "f455d6e0f90f61de38d85f6a312ca47da45c799a616bc0d1d0813e081018bf4d"),
    ("BSD-3-Clause", 1373, "ce258de2eab9d70517d5f8b8b1cb8e8b3ee85157a1e12a4160b7d32c13721f9a"),
    ("BSD-3-Clause", 1374, "1acc99eb1ba443233c09bf313c8b101c6bbaf3cd70d1566c2bb08b290fcf064f"),
    ("BSD-3-Clause", 1380, "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("BSD-3-Clause", 1401, "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
    ("BSD-3-Clause", 1411, "edb9857ad58a6742d6a7ace9384666ca0a3a511ed0c6cdfb0ced2efde12fa049"),
    ("BSD-3-Clause", 1487, "9716a94ee158d4e43277c2a1b82425ef6df1e73f222793c101e9b46846d1dbff"),
    ("BSD-3-Clause", 1530, "660c859ae83ac652b2917057b86c74ef6663523f439e7b4e79324edd7cfdd440"),
    ("CC0-1.0", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", 19583, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", 22018, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", 9424, "7843068060f4d9ee30736221ce49abf6cb7dafa9b775fabb47fbf0c21e05b102"),
    ("GPL-1.0", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", 14483, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", 30968, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", 33408, "9faf4f9b13ca844eeee37346a77dec74f558096ac2b418782a99c8afe4c772da"),
    ("ISC", 676, "280d76b420aeff51730e96577a2466120c91213f03dd50d60107078c498c5b29"),
    ("ISC", 695, "40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db"),
    ("LGPL-2.0", 22277, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", 23365, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MIT", 1000, "6cf640352146a6dbce8acc0576cfc161911d96c00fb726a47aa3b1758bf3fcd6"),
    ("MIT", 1208, "44295ce3f73e95d9265fd78dccb7ef474028956424531092f12c46ea7bbd4e16"),
    ("MPL-1.1", 22467, "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", 14341, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("PSF-2.0", 12614, "eb2a0f6732d9491a99dc29cd643aa926a93f3f918e9f5b87de3463851f309784"),
    ("Zlib", 870, "6087666ecef05cb7086906a468d339490c705f20cff5af1280c59887859b2339"),
]
